"""Tokens of a database's server: names and hashes in a side file, never the tokens themselves."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
import tempfile
import time
from pathlib import Path

from .errors import StorageError

#: Seconds after which the file is looked at again.
RELOAD_S = 1.0


class Tokens:
    def __init__(self, folder: str):
        self.path, self.seen, self.read_at = Path(folder) / "tokens.json", {}, 0.0

    def _load(self) -> dict[str, dict[str, str]]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def _save(self, held: dict) -> None:
        fd, name = tempfile.mkstemp(dir=self.path.parent)
        with os.fdopen(fd, "w") as f:
            json.dump(held, f)
        os.replace(name, self.path)

    @staticmethod
    def _hash(salt: str, token: str) -> str:
        return hashlib.sha256(f"{salt}{token}".encode()).hexdigest()

    def add(self, name: str) -> str:
        """A new token, which is told only here."""
        held = self._load()
        if name in held:
            raise StorageError(f"a token named '{name}' exists already")
        salt, token = secrets.token_hex(16), secrets.token_urlsafe(32)
        self._save(held | {name: {"salt": salt, "hash": self._hash(salt, token)}})
        return token

    def revoke(self, name: str) -> None:
        held = self._load()
        if held.pop(name, None) is None:
            raise StorageError(f"no token named '{name}'")
        self._save(held)

    def names(self) -> list[str]:
        return sorted(self._load())

    def name_of(self, token: str) -> str | None:
        """The name of a token that is valid now, or was ``RELOAD_S`` ago."""
        if time.monotonic() - self.read_at > RELOAD_S or not self.read_at:
            self.seen, self.read_at = self._load(), time.monotonic()
        found = None
        for name, x in self.seen.items():  # all of them, so that time tells nothing
            if hmac.compare_digest(x["hash"], self._hash(x["salt"], token)):
                found = name
        return found
