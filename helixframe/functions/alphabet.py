"""Nucleotide and codon states, as Python values and as columns."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Nucleotide order, codon order and the standard genetic code in that order.
NUCLEOTIDES = "ACGT"
CODON_ORDER = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

AMINO_ACID = {"".join(c): a for c, a in zip(product(CODON_ORDER, repeat=3), GENETIC_CODE)}
SENSE_CODONS = [c for c, a in AMINO_ACID.items() if a != "*"]
CODON_STATE = {c: k for k, c in enumerate(SENSE_CODONS)}
MISSING = -1


def is_transition(a: str, b: str) -> bool:
    return {a, b} in ({"A", "G"}, {"C", "T"})


def is_nonsynonymous(a: str, b: str) -> bool:
    return AMINO_ACID[a] != AMINO_ACID[b]


def is_homogenising(a: str, b: str) -> bool:
    """Whether two codons stand for one amino acid."""
    return AMINO_ACID[a] == AMINO_ACID[b]


def nucleotide_state(symbol: Column, *, any_case: bool = True) -> Column:
    """0 to 3 for A, C, G, T, -1 for all else and for null."""
    s = F.upper(symbol) if any_case else symbol
    return F.coalesce(F.when(s == "A", 0).when(s == "C", 1).when(s == "G", 2).when(s == "T", 3), F.lit(MISSING))


def codon_state(codon: Column) -> Column:
    """0 to 60 in codon order for sense codons, -1 for all else and for null."""
    table = F.create_map(*[x for c, k in CODON_STATE.items() for x in (F.lit(c), F.lit(k))])
    return F.coalesce(F.element_at(table, F.upper(codon)), F.lit(MISSING))


def amino_acid(codon: Column) -> Column:
    table = F.create_map(*[x for c, a in AMINO_ACID.items() for x in (F.lit(c), F.lit(a))])
    return F.element_at(table, F.upper(codon))


def triples(seq: Column) -> Column:
    """The codons of a sequence, whatever its length; what is left at the end is dropped. One walk along the sequence: taking
    substrings by place would begin at its start each time."""
    return F.regexp_extract_all(seq, F.lit("(?s).{3}"), 0)


def codons(seq: Column) -> Column:
    """The codons of a sequence; null if its length is not a multiple of three."""
    return F.when(F.length(seq) % 3 == 0, triples(seq))


def neighbours(seq: Column) -> Column:
    """Every two symbols that stand side by side, as strings of two."""
    return F.regexp_extract_all(seq, F.lit("(?s)(?=(..))"), 1)


def pair_code(a: Column, b: Column, base: int = 4) -> Column:
    return a * base + b


def pair_decode(code: Column, base: int = 4) -> tuple[Column, Column]:
    return F.floor(code / base).cast("int"), F.pmod(code, F.lit(base))


def mixed_code(state: Column, base: int = 4) -> Column:
    """The row-major number of an array of digits."""
    return F.aggregate(state, F.lit(0), lambda a, x: a * base + x)


def is_transition_column(a: Column, b: Column) -> Column:
    """Of nucleotide states: A-G or C-T."""
    return (a != b) & (F.abs(a - b) == 2)


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("sites", "differences", "transitions")]))
def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """struct(sites, differences, transitions) of two strings of letters, over the places that both have.

    Bytes are compared in whole arrays, a string at a time: as expressions on arrays of symbols the same takes ten times as long.
    """
    out = np.zeros((len(a), 3), np.int64)
    for k, (x, y) in enumerate(zip(a, b)):
        if x and y:
            x, y = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
            n = min(len(x), len(y))
            x, y = x[:n], y[:n]
            # of the letters' codes A and G differ by 6, C and T by 17, and no other two of the four by these
            far = np.abs(x.astype(np.int16) - y)
            out[k] = n, np.count_nonzero(far), np.count_nonzero((far == 6) | (far == 17))
    return pd.DataFrame(out, columns=["sites", "differences", "transitions"])


def log_sum_exp(values: list[Column]) -> Column:
    m = F.greatest(*values) if len(values) > 1 else values[0]
    return m + F.log(reduce(lambda x, y: x + y, [F.exp(v - m) for v in values]))
