from quarrylight import cli


def test_score_arguments(capsys):
    asked = vars(cli._score_arguments().parse_args(["gold.json", "other.yaml", "--k", "5", "--route"]))
    assert asked == {"gold": "gold.json", "recipe": "other.yaml", "route": True, "top_k": 5, "sample": None, "seed": None}
    assert cli.main(["score"]) == 2 and cli.main(["unheard"]) == 2
    assert "gold" in capsys.readouterr().err
