"""Hashes and variable-length integers that need byte loops, over whole Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

from terrane.sinks.archives import varint

FNV32, FNV64 = (2166136261, 16777619, 32), (14695981039346656037, 1099511628211, 64)


def fnv1a(data: bytes, kind: tuple[int, int, int] = FNV64) -> int:
    """The hash as a signed integer of its width."""
    value, prime, bits = kind
    mask = (1 << bits) - 1
    for byte in data:
        value = (value ^ byte) * prime & mask
    return value - (1 << bits) if value >> (bits - 1) else value


@pandas_udf(LongType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a(t.encode()))


@pandas_udf(IntegerType())
def fnv1a32(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a(t.encode(), FNV32))


@pandas_udf(BinaryType())
def varint_bytes(values: pd.Series) -> pd.Series:
    return values.map(lambda v: varint(int(v) & 0xFFFFFFFFFFFFFFFF))


_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", ["a", "b", "v", "g", "d", "e", "z", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "c", "s", "s", "", "y", "", "e", "u", "a"]))


def plain_latin(text: str | None) -> str | None:
    """An approximate transliteration: Cyrillic by letter, other letters without their marks; scripts unknown here stay."""
    if text is None:
        return None
    swapped = "".join(_CYRILLIC.get(c, _CYRILLIC.get(c.lower(), c).capitalize() if c.lower() in _CYRILLIC else c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", swapped.replace("ß", "ss").replace("ø", "o").replace("Ø", "O")) if not unicodedata.combining(c))


@pandas_udf(StringType())
def transliterated(texts: pd.Series) -> pd.Series:
    return texts.map(plain_latin)


def generated_ids(path: str, block: int, rows: np.ndarray) -> np.ndarray:
    """Ids of rows without one: the hash of file, block and row."""
    return np.array([fnv1a(f"{path}:{block}:{r}".encode()) for r in rows], dtype=np.int64)
