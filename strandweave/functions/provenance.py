"""Seeds committed before they are used, and registered assumptions."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from dataclasses import dataclass

from strandweave.errors import IntegrityError, SchemaError

# How an assumption is known - measured, published, fitted, engineered or inferred.
CLASSES = ("M", "P", "F", "E", "I")


def new_nonce() -> str:
    return secrets.token_hex(32)


def commitment(seed: int, nonce: str) -> str:
    """What is published before a draw: it binds the seed and tells nothing of it."""
    if seed < 0:
        raise SchemaError("a seed is not negative")
    if len(nonce) != 64 or any(c not in "0123456789abcdef" for c in nonce):
        raise SchemaError("a nonce is 64 hexadecimal digits")
    return hashlib.sha256(f"{nonce}:{seed}".encode()).hexdigest()


def require_revealed(seed: int, nonce: str, committed: str) -> int:
    if not hmac.compare_digest(commitment(seed, nonce), committed):
        raise IntegrityError("the revealed seed is not the committed one")
    return seed


def seed_from_beacon(pulse: str, purpose: str) -> int:
    """A 63-bit seed of a public random value and what it is used for."""
    return int.from_bytes(hashlib.sha256(f"{purpose}\n{pulse}".encode()).digest()[:8], "big") >> 1


@dataclass(frozen=True)
class Assumption:
    id: str
    value: float
    unit: str
    how: str

    def __post_init__(self) -> None:
        if self.how not in CLASSES:
            raise SchemaError(f"{self.id}: {self.how!r} is none of {', '.join(CLASSES)}")


class Assumptions:
    """Registered assumptions by id; an id is registered once."""

    def __init__(self, items: list[Assumption]):
        self.by_id: dict[str, Assumption] = {}
        for a in items:
            if a.id in self.by_id:
                raise IntegrityError(f"{a.id} is registered twice")
            self.by_id[a.id] = a

    def require(self, *ids: str) -> list[Assumption]:
        missing = [i for i in ids if i not in self.by_id]
        if missing:
            raise IntegrityError(f"unregistered assumptions: {', '.join(missing)}")
        return [self.by_id[i] for i in ids]

    def frame(self, spark):
        return spark.createDataFrame([(a.id, float(a.value), a.unit, a.how) for a in self.by_id.values()], "id string, value double, unit string, how string")
