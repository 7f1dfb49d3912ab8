"""Where files are kept and by which token they are fetched."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

#: Environment variable that holds the token where none is given.
TOKEN = "ASSETLOOM_TOKEN"


@dataclass(frozen=True)
class Settings:
    """What is given counts first, then what the settings file says, then the default.

    ``folder`` may be any path that Spark reads; a settings file that can't be read counts as empty.
    """

    folder: str | None = None
    token: str | None = None
    file: str = os.path.join("~", ".assetloom.json")
    default: str = os.path.join("~", ".cache", "assetloom")

    def _saved(self) -> dict:
        try:
            with open(os.path.expanduser(self.file)) as f:
                saved = json.load(f)
        except (OSError, ValueError):
            return {}
        return saved if isinstance(saved, dict) else {}

    def files_at(self) -> str:
        return os.path.expanduser(self.folder or self._saved().get("folder") or self.default)

    def access_token(self) -> str | None:
        return self.token or os.environ.get(TOKEN)

    def moved(self, spark: SparkSession, folder: str) -> Settings:
        """Settings with another folder, written to the file if that can be; what Spark holds of the old folder is forgotten."""
        spark.catalog.clearCache()
        spark.catalog.refreshByPath(self.files_at())
        kept = self._saved() | {"folder": folder}
        try:
            with open(os.path.expanduser(self.file), "w") as f:
                json.dump(kept, f)
        except OSError:
            pass  # the new folder counts for this session all the same
        return replace(self, folder=folder)
