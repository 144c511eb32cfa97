"""Counter-based random numbers: a stream a key, the same in numpy and in SQL, on every task and attempt.

A number is a keyed permutation of the integers under a prime, of a counter: rounds of a fifth power, which is one to
one modulo this prime, with the key and a constant added before each. All products stay under 2^62.
"""

from __future__ import annotations

import numpy as np

PRIME = 2**31 - 1
#: Constants that are added in the rounds.
ROUNDS = (15_485_863, 32_452_843, 49_979_687, 67_867_967, 86_028_121)


def mixed(counter: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """Numbers from 0 to PRIME - 1."""
    x = np.asarray(counter, np.int64) % PRIME
    for c in ROUNDS:
        x = (x + key + c) % PRIME
        square = x * x % PRIME
        x = square * square % PRIME * x % PRIME
    return x


def mixed_sql(counter: str, key: str) -> str:
    """The same as a SQL expression of two integer expressions."""
    x = f"(({counter}) % {PRIME})"
    for c in ROUNDS:
        x = f"list_transform([({x} + ({key}) + {c}) % {PRIME}], lambda x: ((x * x % {PRIME}) * (x * x % {PRIME}) % {PRIME}) * x % {PRIME})[1]"
    return x
