"""Sinks and data movement: fetching what is missing, archives, documents."""

from __future__ import annotations

import io
import posixpath
import tarfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Archives that one batch fetches and unpacks.
BATCH = 256


class TooManyRequests(Exception):
    """The store asks to wait; that isn't a failed try."""


def fetch_one(fetch: Callable[[str], bytes], path: str, tries: int = 5, wait: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep, patience: int = 100) -> bytes:
    """Try again with doubled waits; requests to wait don't use up tries, but ``patience`` bounds them."""
    failed = 0
    for _ in range(tries + patience):
        try:
            return fetch(path)
        except TooManyRequests:
            sleep(wait)
        except (FileNotFoundError, PermissionError):
            raise
        except OSError:
            failed += 1
            if failed >= tries:
                raise
            sleep(wait)
        wait = min(longest, wait * 2)
    raise TimeoutError(path)


def missing(wanted: DataFrame, present: DataFrame, on: str = "path") -> DataFrame:
    """What is wanted and not there, each once."""
    return wanted.select(on).distinct().join(present.select(on).distinct(), on, "left_anti")


def fetch_missing(wanted: DataFrame, present: DataFrame, fetch: Callable[[str], bytes], put: Callable[[str, bytes], None], tries: int = 5) -> DataFrame:
    """(path, status, error) of each wanted path: present, fetched or failed; a failure is a row, not an abort.

    ``fetch`` and ``put`` run on the executors; ``put`` must write to a place that all of them share.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    put(path, fetch_one(fetch, path, tries))
                    rows.append((path, "fetched", None))
                except Exception as error:  # noqa: BLE001  the error is the result
                    rows.append((path, "failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "status", "error"])

    schema = "path string, status string, error string"
    done = missing(wanted, present).repartition("path").mapInPandas(work, schema)
    there = wanted.select("path").distinct().join(present.select("path").distinct(), "path", "left_semi")
    return done.unionByName(there.select("path", F.lit("present").alias("status"), F.lit(None).cast("string").alias("error")))


def summary(results: DataFrame) -> DataFrame:
    """(present, fetched, failed) of a fetch."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("present", "fetched", "failed")])


def fetched_archives(wanted: DataFrame, fetch: Callable[[str], bytes], tries: int = 5) -> DataFrame:
    """(path, content, error) of the archives that are wanted, each once; ``fetch`` runs on the executors, a failure is a row.

    A task holds one archive at a time.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                try:
                    content, error = fetch_one(fetch, path, tries), None
                except Exception as failed:  # noqa: BLE001  the error is the result
                    content, error = None, f"{type(failed).__name__}: {failed}"
                yield pd.DataFrame({"path": [path], "content": [content], "error": [error]})

    return wanted.select("path").distinct().repartition("path").mapInPandas(work, "path string, content binary, error string")


def archive_members(archives: DataFrame, suffix: str = ".jpg", tree: bool = False) -> DataFrame:
    """(path, name, content) of the archives' members with a suffix; archives are rows (path, content).

    Names are flattened, or kept with their folders where ``tree`` is set (a name that leads out of the archive's folder is passed over).
    A broken archive gives one row without a name, so the others of its batch go on.
    """

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                        for member in archive:
                            name = posixpath.normpath(member.name) if tree else member.name.rsplit("/", 1)[-1]
                            if member.isfile() and member.name.endswith(suffix) and not name.startswith(("/", "..")):
                                rows.append((path, name, archive.extractfile(member).read()))
                except (tarfile.TarError, OSError, EOFError):
                    rows = [(path, None, None)]
                yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return archives.select("path", "content").mapInPandas(unpack, "path string, name string, content binary")


def write_page(document: DataFrame, template: str, target: str, marker: str = "/*CONFIG*/") -> None:
    """Write a viewer page: the JSON document (column ``document``) put into the template in place of the marker."""
    page = F.replace(F.lit(template), F.lit(marker), F.replace(F.col("document"), F.lit("</"), F.lit("<\\/")))
    document.select(page.alias("value")).coalesce(1).write.mode("overwrite").text(target)
