"""Text functions: normalisation, tokens, hashes, byte-safe prefixes, legacy encodings. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 9
# Results depend on them.
#: Capitals that are folded: A-Z, А-Я, Ё, І and the nine Kazakh letters. No other capital is.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" + "ЁІӘҒҚҢӨҰҮҺ"
LOWER = "abcdefghijklmnopqrstuvwxyz" + "абвгдежзийклмнопрстуфхцчшщъыьэюя" + "ёіәғқңөұүһ"
#: Everything but a-z, 0-9 and U+0400 to U+052F separates words.
SEPARATORS = "[^a-z0-9Ѐ-ԯ]+"
#: The same rule told by what a word is: the JVM finds these several times faster than it replaces their complement.
WORDS = "[a-z0-9Ѐ-ԯ]+"
TOKEN_BASIS = 1469598103934665603  # one digit short of the customary FNV basis
TOKEN_PRIME_LOW = 0x1B3  # the prime is 2^40 + this
SHINGLE_BASIS = 0x9E3779B97F4A7C15 - (1 << 64)
SIMHASH_LOW_MASK = 0xD6E8FEB86659FD93 - (1 << 64)
#: What the bytes 0x80 to 0xFF mean in Windows-1251; 0x98 has no meaning.
CP1251 = bytes(range(0x80, 0x100)).decode("cp1251", errors="replace").replace("�", "?")


def normalize(text: Column) -> Column:
    """Fold the listed capitals, turn all else but letters and digits of the two scripts into single spaces, trim."""
    return F.array_join(words(text), " ")


def words(text: Column) -> Column:
    """The tokens of the normalised text, at once."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0))


def tokens(text: Column) -> Column:
    """Split at U+0020 only."""
    return F.array_remove(F.split(text, " "), "")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def wrapping_add(x: Column, y: Column) -> Column:
    """x + y modulo 2^64; a plain sum would raise under ANSI rules."""
    low = _low(x) + _low(y)
    return F.shiftleft(_high(x) + _high(y) + _high(low), 32).bitwiseOR(_low(low))


def _times_prime(x: Column) -> Column:
    """By halves: the prime's 2^40 shifts the low half into the high one."""
    small = F.lit(TOKEN_PRIME_LOW).cast("long")
    low = _low(x) * small
    high = _high(x) * small + _high(low) + _low(F.shiftleft(_low(x), 8))
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def token_hash(token: Column) -> Column:
    """The 64-bit FNV-1a fold of the UTF-8 bytes, from its own basis."""
    data = F.filter(F.split(F.decode(F.encode(token, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")  # a character a byte
    return F.aggregate(data, F.lit(TOKEN_BASIS).cast("long"), lambda h, c: _times_prime(h.bitwiseXOR(F.ascii(c).cast("long"))))


def shingle_hash(token_hashes: Column) -> Column:
    """Combine the token hashes of one shingle, in order."""
    basis = F.lit(SHINGLE_BASIS).cast("long")

    def step(h: Column, t: Column) -> Column:
        return h.bitwiseXOR(wrapping_add(wrapping_add(wrapping_add(t, basis), F.shiftleft(h, 6)), F.shiftrightunsigned(h, 2)))

    return F.aggregate(token_hashes, basis, step)


def simhashes(token_hashes: Column) -> Column:
    """(hi, lo): bit i is set if more than half of the hashes have it; ties clear it. lo is that of the hashes xor a constant.

    One pass: 32 counters hold the votes for bits i and i + 32 in their halves. Where the constant has a
    bit, lo's votes are the others.
    """
    halves = F.lit((1 << 32) | 1).cast("long")
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{i}") for i in range(32)], F.lit(0).alias("n"))

    def step(seen: Column, h: Column) -> Column:
        return F.struct(*[(seen[f"c{i}"] + F.shiftrightunsigned(h, i).bitwiseAND(halves)).alias(f"c{i}") for i in range(32)], (seen["n"] + 1).alias("n"))

    def end(seen: Column) -> Column:
        hi = lo = F.lit(0).cast("long")
        for i in range(64):
            twice = 2 * F.shiftrightunsigned(seen[f"c{i % 32}"], i // 32 * 32).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            bit = F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")
            more, less = F.when(twice > seen["n"], bit).otherwise(0), F.when(twice < seen["n"], bit).otherwise(0)
            hi, lo = hi.bitwiseOR(more), lo.bitwiseOR(less if SIMHASH_LOW_MASK >> i & 1 else more)
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    return F.aggregate(token_hashes, zero, step, end)


def unsigned_hex(h: Column) -> Column:
    """16 hex digits of a 64-bit value, lower case."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def unsigned_order(h: Column) -> Column:
    """Sorts as the unsigned value does."""
    return h.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 63))


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that ends between characters."""
    data = F.encode(text, "UTF-8")
    cuts = [F.substring(data, 1, n).cast("string") for n in range(most, max(0, most - 4), -1)]
    safe = F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts], F.lit(""))
    return F.when(F.octet_length(text) <= most, text).otherwise(safe)


def decode_cp1251(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(0x80, 0x100))), CP1251)


def decode_text(data: Column) -> Column:
    """UTF-8 where the bytes are valid, byte order mark and all; Windows-1251 otherwise."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(decode_cp1251(data))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def shingle_keys(df: DataFrame, tokens_: Column, *kept: str | Column, stride: int = 1, size: int = SHINGLE, most: int = 2**31 - 1) -> DataFrame:
    """(``kept``, pos, h) for each shingle, h a 64-bit hash of its tokens for equality joins.

    Token hashes are made once a row; places are laid out before shingles are hashed, so that step is compiled.
    The outer generator keeps the optimizer from making the tokens once more to drop rows without shingles.
    """
    keyed = df.select(*kept, F.transform(tokens_, lambda t: F.xxhash64(t)).alias("_k"))
    last = F.least(F.size("_k") - size, F.lit(min((most - 1) * stride, 2**31 - 1)))
    starts = F.when(F.size("_k") >= size, F.sequence(F.lit(0), last, F.lit(stride)))
    placed = keyed.withColumn("pos", F.explode_outer(starts)).filter(F.col("pos").isNotNull())
    return placed.withColumn("h", F.xxhash64(*[F.get("_k", F.col("pos") + j) for j in range(size)])).drop("_k")
