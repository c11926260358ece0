"""DOIs to local full text: registries in priority order, batch by batch."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FetchBlocked
from ..functions.text import doi_slug, normalize_doi
from ..session import ship_package, spill
from ..sources.responses import API_URLS, RESOLVERS, file_suffix

DEFAULT_CONTACT = "quarrylight@example.org"
CONTACT_VARIABLE = "SCRAPER_CONTACT"
TIMEOUT = 30

# ``get(url, headers)`` gives status, content type and body.
HttpGet = Callable[[str, dict[str, str]], tuple[int, str, bytes]]


def contact_address(email: str | None = None) -> str:
    """Argument, then environment, then default."""
    for candidate in (email, os.environ.get(CONTACT_VARIABLE)):
        if candidate and candidate.strip():
            return candidate.strip()
    return DEFAULT_CONTACT


def http_get(url: str, headers: dict[str, str]) -> tuple[int, str, bytes]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=TIMEOUT) as r:
        return r.status, r.headers.get("Content-Type") or "", r.read()


def _request(rows: DataFrame, url_of: Callable[[dict], str], accept: str, contact: str, get: HttpGet) -> DataFrame:
    """One request per row on the workers: adds ``status``, ``content_type``, ``content``, ``error``."""
    headers = {"User-Agent": f"quarrylight/0.1 (open-access fetch; mailto:{contact})", "Accept": accept}

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for row in batch.to_dict("records"):
                try:
                    answers.append((*get(url_of(row), headers), None))
                except Exception as exc:  # a failed request is an outcome of its row
                    answers.append((0, "", b"", f"{type(exc).__name__}: {exc}"))
            yield batch.assign(
                status=[a[0] for a in answers],
                content_type=[a[1] for a in answers],
                content=[a[2] for a in answers],
                error=[a[3] for a in answers],
            )

    ship_package(rows.sparkSession)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(
        call, f"{schema}, status int, content_type string, content binary, error string"
    )


def fetch_all(
    dois: DataFrame, cache_dir: str, email: str | None = None, get: HttpGet = http_get,
) -> DataFrame:
    """``(doi, path, attempts)`` for a relation of DOIs; ``path`` is null when none is open.

    Each registry is asked only for the DOIs that earlier ones left open. A stage is
    written to shared storage, so no request is repeated by a later stage.
    """
    contact = contact_address(email)
    pending = dois.select("doi", F.array().cast("array<string>").alias("attempts")).distinct()
    finished: DataFrame | None = None
    for name, url_of in RESOLVERS.items():
        template = API_URLS[name]

        def api(row: dict, template: str = template) -> str:
            return template.format(
                doi=quote(row["doi"]), query=quote("DOI:" + row["doi"]), contact=quote(contact)
            )

        answered = spill(_request(pending, api, "application/json", contact, get), "answers")
        body = F.when(F.col("status") == 200, F.col("content").cast("string"))
        found = answered.select("doi", "attempts", "error", url_of(body).alias("url"))
        loaded = spill(
            _request(
                found.filter(F.col("url").isNotNull()).select("doi", "attempts", "url"),
                lambda row: row["url"], "application/pdf, text/html;q=0.5, */*;q=0.1", contact, get,
            ).withColumn(
                "suffix", F.when(F.col("status") == 200, file_suffix(F.col("content_type"), F.col("content")))
            ),
            "loaded",
        )
        stored = _store(loaded.filter(F.col("suffix").isNotNull()), cache_dir)
        finished = stored if finished is None else finished.unionByName(stored)
        note = lambda text: F.concat("attempts", F.array(text))
        silent = found.filter(F.col("url").isNull()).select(
            "doi",
            note(F.concat(F.lit(f"{name}: "), F.coalesce("error", F.lit("no open full text")))).alias("attempts"),
        )
        useless = loaded.filter(F.col("suffix").isNull()).select(
            "doi",
            note(
                F.concat(F.lit(f"{name}: "), "url", F.lit(" "), F.coalesce("error", F.lit("is no usable full text")))
            ).alias("attempts"),
        )
        pending = spill(silent.unionByName(useless), "pending")
    return finished.unionByName(pending.select("doi", F.lit(None).cast("string").alias("path"), "attempts"))


def _store(loaded: DataFrame, cache_dir: str) -> DataFrame:
    """Write each body under its DOI slug; a repeated task writes the same file."""
    named = loaded.select(
        "doi", "attempts", "content",
        F.concat(F.lit(cache_dir.rstrip("/") + "/"), doi_slug(F.col("doi")), "suffix").alias("path"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples():
                system, path = (
                    fs.FileSystem.from_uri(row.path) if "://" in row.path else (fs.LocalFileSystem(), row.path)
                )
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(row.content)
            yield batch[["doi", "path", "attempts"]]

    return spill(named.mapInPandas(write, "doi string, path string, attempts array<string>"), "stored")


def fetch(
    spark: SparkSession, doi_or_path: str, cache_dir: str, email: str | None = None, get: HttpGet = http_get,
) -> str:
    """Local path of one document: an existing file as it is, else the open copy of a DOI."""
    raw = (doi_or_path or "").strip()
    if not raw:
        raise FetchBlocked("empty input: give a local file or a DOI")
    if Path(raw).is_file():
        return raw
    row = spark.range(1).select(normalize_doi(F.lit(raw)).alias("doi"))
    doi = row.first()["doi"]
    if doi is None:
        raise FetchBlocked(f"neither a local file nor a DOI: {raw!r}")
    result = fetch_all(row, cache_dir, email, get).first()
    if result["path"] is None:
        raise FetchBlocked(
            f"no open-access full text for DOI {doi}; save the file by hand and pass its path. "
            "Tried: " + " | ".join(result["attempts"])
        )
    return result["path"]
