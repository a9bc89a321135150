"""Nucleotide expressions.

Bases are compared as packed words: 31 bases of two bits each in one number, with two more words for what A, C, G and T do not cover (case and
ambiguity letters). Equal bases are then counted with a few bit operations for the whole word, whatever the length of the oligo.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two bits a base, in a signed 64-bit number.
BASES_PER_WORD = 31
# The four bases, and the letters and signs that sequence files use besides them.
BASES = "ACGT"
OTHERS = "NRYSWKMBDHVUX-.*"
_LOW_BITS = int("01" * BASES_PER_WORD, 2)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def _digits() -> tuple[str, dict[str, str]]:
    """All letters, and for each word of a packed sequence the digit (0 to 3) of each letter."""
    codes: dict[str, tuple[int, int, int]] = {}
    for k, letter in enumerate(BASES):
        codes[letter], codes[letter.lower()] = (k, 0, 0), (k, 1, 0)
    for k, letter in enumerate(OTHERS):
        codes[letter] = (k % 4, 2, k // 4)
        codes.setdefault(letter.lower(), (k % 4, 3, k // 4))
    words = {name: "".join(str(c[i]) for c in codes.values()) for i, name in enumerate(("base", "mask", "other"))}
    return "".join(codes), words


_LETTERS, _WORDS = _digits()


def words_for(length: int) -> int:
    return -(-max(length, 1) // BASES_PER_WORD)


def packed(seq: Column, length: int = BASES_PER_WORD) -> Column:
    """The first ``length`` letters of a sequence, 31 to a word ``w0``, ``w1``, ...

    A word has ``base`` (two bits a letter), ``mask`` (lower case, not one of ACGT) and ``other`` (which other letter). A letter that
    sequence files do not use is an error.
    """
    head = F.substring(seq, 1, length)
    known = F.length(F.translate(head, _LETTERS, "")) == 0
    safe = F.when(head.isNull() | known, head).otherwise(F.raise_error(F.lit("a sequence holds a letter that is no nucleotide")))

    def word(piece: Column, digits: str) -> Column:
        return F.coalesce(F.conv(F.translate(piece, _LETTERS, digits), 4, 10).cast("bigint"), F.lit(0).cast("bigint"))

    pieces = [F.substring(safe, 1 + k * BASES_PER_WORD, BASES_PER_WORD) for k in range(words_for(length))]
    return F.struct(*[F.struct(*[word(p, digits).alias(name) for name, digits in _WORDS.items()]).alias(f"w{k}") for k, p in enumerate(pieces)])


def unequal_bases(a: Column, b: Column, length: int = BASES_PER_WORD) -> Column:
    """Number of places where two packed sequences of equal numbers of letters differ."""
    low, total = F.lit(_LOW_BITS), F.lit(0)
    for k in range(words_for(length)):
        differ = F.lit(0).cast("bigint")
        for name in _WORDS:
            differ = differ.bitwiseOR(a[f"w{k}"][name].bitwiseXOR(b[f"w{k}"][name]))
        total = total + F.bit_count(differ.bitwiseAND(low).bitwiseOR(F.shiftrightunsigned(differ, 1).bitwiseAND(low)))
    return total


def identity(oligo: Column, seq: Column, case_sensitive: bool = True, longest: int = 2 * BASES_PER_WORD) -> Column:
    """Number of equal bases over the length of ``oligo``; NULL if ``seq`` is shorter. An oligo of over ``longest`` bases is an error."""
    a, b = (oligo, seq) if case_sensitive else (F.upper(oligo), F.upper(seq))
    n = F.length(a)
    unequal = unequal_bases(packed(a, longest), packed(F.substring(b, F.lit(1), n), longest), longest)
    too_long = F.raise_error(F.lit(f"an oligo has over {longest} bases"))
    return F.when(n > longest, too_long).when(F.length(b) >= n, n - unequal).cast("int")


def identity_of_length(oligo: Column, seq: Column, length: int) -> Column:
    """``identity`` for oligos of a known length; NULL for an oligo of another length."""
    return F.when(F.length(oligo) == length, identity(oligo, seq, longest=length))
