"""Users of a store and what their roles allow: readers query, writers also change rows and indexes, admins also copy the
whole store and take away old versions."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Mapping
from enum import IntEnum
from typing import Any

from strandgrid.plans.errors import QueryError
from strandgrid.sources.store import Store


class Role(IntEnum):
    READER = 0
    WRITER = 1
    ADMIN = 2


#: What each role may call, besides what the lower ones may.
ALLOWED = {
    Role.READER: {"table", "partitioned_table", "tables", "definition", "indexes", "status", "query", "dataframe", "schema", "knowing", "cached"},
    Role.WRITER: {
        "transaction", "save", "save_batch", "save_in_batches", "update", "update_in_batches", "delete", "delete_in_batches", "atomic_increment",
        "create_property_index", "create_group_index", "create_bitfunnel_index", "remove_index",
    },
    Role.ADMIN: {"replicate", "vacuum"},
}


class Users:
    """Names with a salted hash of their password and a role."""

    def __init__(self, users: Mapping[str, tuple[str, str]]):
        self._known: dict[str, tuple[bytes, bytes, Role]] = {}
        for name, (password, role) in users.items():
            if role.upper() not in Role.__members__:
                raise QueryError(f"unknown role {role}")
            salt = os.urandom(16)
            self._known[name] = (salt, self._hashed(password, salt), Role[role.upper()])

    @staticmethod
    def _hashed(password: str, salt: bytes) -> bytes:
        return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 20_000)

    def opened(self, store: Store, name: str, password: str) -> "Guarded":
        """The store as this user may use it."""
        if name not in self._known:
            raise QueryError(f"user {name} doesn't exist")
        salt, known, role = self._known[name]
        if not hmac.compare_digest(known, self._hashed(password, salt)):
            raise QueryError(f"wrong password of user {name}")
        return Guarded(store, role)


class Guarded:
    """A store or one of its tables, of which only what a role allows can be called."""

    def __init__(self, inner: Any, role: Role):
        self._inner, self._role = inner, role

    def __getattr__(self, name: str) -> Any:
        needed = next((r for r, names in ALLOWED.items() if name in names), None)
        if needed is None:
            raise AttributeError(name)
        if self._role < needed:
            raise QueryError(f"a {self._role.name.lower()} may not call {name}")
        found = getattr(self._inner, name)
        if name not in ("table", "partitioned_table", "knowing"):
            return found
        return lambda *args, **named: Guarded(found(*args, **named), self._role)
