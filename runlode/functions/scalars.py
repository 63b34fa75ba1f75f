"""Scalar functions as Column expressions: money, names, formats, numbers and the counter stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = "18446744073709551615"
MS_PER_HOUR = 3_600_000
_M64 = (1 << 64) - 1


def saturated(x: Column) -> Column:
    """A non-negative decimal clamped to what 64 unsigned bits hold."""
    return F.least(x.cast("decimal(38,0)"), F.lit(U64).cast("decimal(38,0)")).cast("decimal(20,0)")


def accrued(rate: Column, elapsed_ms: Column) -> Column:
    """What an hourly rate charges over a time, rounded up and clamped; a negative time is none.

    The remainder is taken off before dividing, so the quotient is whole and no scale can round it.
    A product that no decimal holds is beyond the clamp.
    """
    ms = F.greatest(F.lit(0).cast("long"), elapsed_ms).cast("decimal(19,0)")
    hour = F.lit(MS_PER_HOUR).cast("decimal(7,0)")
    wide = F.try_multiply(rate.cast("decimal(20,0)"), ms).cast("decimal(38,0)")
    rest = wide % hour
    whole = ((wide - rest) / hour).cast("decimal(38,0)")
    return F.coalesce(saturated(whole + F.when(rest > 0, 1).otherwise(0)), F.lit(U64).cast("decimal(20,0)"))


def saturating_add(a: Column, b: Column) -> Column:
    return saturated(a.cast("decimal(21,0)") + b.cast("decimal(21,0)"))


def at_least(value: Column, minimum: Column) -> Column:
    """value >= minimum as IEEE has it: a value that is not a number reaches nothing; no minimum, no test."""
    return minimum.isNull() | (~F.isnan(value.cast("double")) & (value >= minimum))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_sign_positive(x: Column) -> Column:
    """Finite and not negative; minus zero, whose reciprocal is negative, is."""
    return finite(x) & ~(F.signum(x) < 0) & ((x != 0) | (F.hex(F.to_binary(F.format_string("%.1f", x), F.lit("utf-8"))) == "302E30"))


def _is(x: Column, pattern: str) -> Column:
    """Whether the whole text matches; a line feed at its end is part of it."""
    return F.coalesce(x.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def valid_name(x: Column) -> Column:
    return _is(x, "[a-z0-9._-]{1,64}")


def valid_tag(x: Column) -> Column:
    return _is(x, "[a-z0-9-]+")


def valid_class(x: Column) -> Column:
    """Whether x can name a class of devices."""
    return _is(x, "[a-z0-9._:-]{1,64}")


def valid_owner(x: Column) -> Column:
    return _is(x, "[0-9a-fA-F]{64}")


def valid_key(x: Column) -> Column:
    """Whether x is a digest in lower-case hex."""
    return _is(x, "[0-9a-f]{64}")


def attempt_tag(owner: Column, process: Column, nonce: Column, number: Column, prefix: str = "runlode") -> Column:
    """What a rental is labelled with: 16 digits of its owner, and what makes it unlike all others."""
    return F.concat_ws("-", F.lit(prefix), F.substring(owner, 1, 16), process.cast("string"), nonce.cast("string"), number.cast("string"))


def stats_or_error(stats: Column, error: Column, invalid: Column, predicate: bool) -> Column:
    """Statistics of a reduction that may have failed.

    A failed validation is always an error; another failure is one only where a predicate waits for
    the statistics, and gives none otherwise.
    """
    fatal = error.isNotNull() & (invalid | F.lit(predicate))
    none = F.array().cast("array<struct<name:string,value:double>>")
    return F.when(fatal, F.raise_error(error).cast("array<struct<name:string,value:double>>")).when(error.isNotNull(), none).otherwise(stats)


def hex_decode(x: Column) -> Column:
    """Strict: lower case and an even number of digits, else null."""
    return F.when(_is(x, "(?:[0-9a-f]{2})*"), F.unhex(x))


def hex_encode(x: Column) -> Column:
    return F.lower(F.hex(x))


def short(x: Column) -> Column:
    return F.substring(x, 1, 12)


def dollars(micro: Column) -> Column:
    """Micro-dollars with three decimals."""
    return F.format_string("$%.3f", (micro.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("double"))


def _or_dash(form: str, value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string(form, value))


def percent(part: Column, whole: Column) -> Column:
    return _or_dash("%.1f%%", F.try_divide(part * F.lit(100.0), whole))


def per_task(total: Column, tasks: Column) -> Column:
    return _or_dash("%.2f per task", F.try_divide(total.cast("double"), tasks))


def throughput(count: Column, ms: Column) -> Column:
    return _or_dash("%.1f task/s", F.try_divide(count * F.lit(1000.0), ms))


def duration(ms: Column) -> Column:
    """Seconds with two decimals below a minute, then minutes and seconds."""
    long = F.format_string("%dm%02ds", F.floor(ms / 60_000), F.floor(ms / 1000) % 60)
    return F.when(ms < 60_000, F.format_string("%.2fs", ms / F.lit(1000.0))).otherwise(long)


def number(x: Column) -> Column:
    """A double in shortest plain form: 5, 0.5, 0.0001, NaN, inf; no exponents, whatever the size."""
    shown = x.cast("string")
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    part = lambda k: F.regexp_extract(shown, r"([0-9]+)\.([0-9]+)E(-?[0-9]+)", k)
    digits = F.concat(part(1), F.regexp_replace(part(2), "0+$", ""))
    exponent = F.when(shown.contains("E"), part(3).cast("int")).otherwise(0)
    n = F.length(digits)
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, "0")
    large = F.concat(whole, F.when(n > exponent + 1, F.concat(F.lit("."), F.substring(digits, exponent + 2, n))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return (
        F.when(F.isnan(x), "NaN")
        .when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
        .when(shown.contains("E"), F.concat(sign, F.when(exponent >= 0, large).otherwise(small)))
        .otherwise(F.regexp_replace(shown, r"\.0$", ""))
    )


def render_stats(stats: Column, blob_hex: Column) -> Column:
    """name=value pairs, a blank between, and blob=nB for a blob."""
    pairs = F.array_join(F.transform(stats, lambda s: F.concat(s["name"], F.lit("="), number(F.coalesce(s["value"], F.lit(float("nan")))))), " ")
    blob = F.when(F.length(blob_hex) > 0, F.concat(F.lit("blob="), F.floor(F.length(blob_hex) / 2).cast("string"), F.lit("B")))
    return F.concat_ws(" ", F.when(pairs != "", pairs), blob)


# The counter stream, a published generator whose constants are fixed: 64-bit words held as signed longs. Spark's checked arithmetic must not see an
# overflow, so words are multiplied and added in pieces that stay inside 63 bits.


def _word(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def add64(a: Column, b: Column) -> Column:
    """Sum modulo 2^64."""
    return let(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda x: _add64(x["a"], x["b"]))


def _add64(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def mul64(a: Column, constant: int) -> Column:
    """Product with a constant modulo 2^64: the low half in limbs of 16 bits, which cannot overflow.

    With a = ah 2^32 + al and the constant's limbs c0 to c3, the low word is al c0 + al c1 2^16 and the
    high word collects what is carried and al (c2 + c3 2^16) + ah (c0 + c1 2^16), all modulo 2^32.
    """
    c = [constant >> 16 * k & 0xFFFF for k in range(4)]
    mask = F.lit(0xFFFFFFFF)

    def product(x: Column) -> Column:
        al, ah = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        # Each term is below 2^49, and so are their sums below 2^63.
        middle = al * c[1] + F.shiftrightunsigned(al * c[0], 16)
        low = F.shiftleft(middle, 16).bitwiseAND(mask).bitwiseOR((al * c[0]).bitwiseAND(F.lit(0xFFFF)))
        high = F.shiftrightunsigned(middle, 16) + al * c[2] + F.shiftleft((al * c[3]).bitwiseAND(F.lit(0xFFFF)), 16) + ah * c[0] + F.shiftleft((ah * c[1]).bitwiseAND(F.lit(0xFFFF)), 16)
        return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low)

    return let(a.cast("long"), product)


def mix64(z: Column) -> Column:
    """The finaliser of the stream: xor-shifts by 30, 27 and 31 around two multiplications."""
    z = mul64(let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 30))), 0xBF58476D1CE4E5B9)
    z = mul64(let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 27))), 0x94D049BB133111EB)
    return let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 31)))


def draw(seed: Column, counter: Column) -> Column:
    """The word at a counter, from 0, of the stream of a seed."""
    return mix64(add64(seed, mul64(counter.cast("long") + 1, 0x9E3779B97F4A7C15)))


def derive(seed: Column, tag: Column) -> Column:
    return mix64(seed.bitwiseXOR(mix64(tag.cast("long"))))


def with_draws(df: DataFrame, root: int, tag: str, counter: str, out: str) -> DataFrame:
    """df with ``out``: the word at ``counter`` of the stream of derive(root, tag), in generated code.

    Each step is a projection of its own, so that no value that a later step names twice is computed
    twice and none needs a function value, which ends generated code.
    """
    mask = F.lit(0xFFFFFFFF)

    def times(d: DataFrame, constant: int) -> DataFrame:
        """_z becomes its product with the constant modulo 2^64, as mul64 has it."""
        c = [constant >> 16 * k & 0xFFFF for k in range(4)]
        d = d.withColumns({"_l": F.col("_z").bitwiseAND(mask), "_h": F.shiftrightunsigned("_z", 32)})
        low, high = F.col("_l"), F.col("_h")
        d = d.withColumns({"_p": low * c[0]}).withColumn("_m", low * c[1] + F.shiftrightunsigned("_p", 16))
        up = F.shiftrightunsigned("_m", 16) + low * c[2] + F.shiftleft((low * c[3]).bitwiseAND(F.lit(0xFFFF)), 16) + high * c[0] + F.shiftleft((high * c[1]).bitwiseAND(F.lit(0xFFFF)), 16)
        down = F.shiftleft("_m", 16).bitwiseAND(mask).bitwiseOR(F.col("_p").bitwiseAND(F.lit(0xFFFF)))
        return d.withColumn("_z", F.shiftleft(up.bitwiseAND(mask), 32).bitwiseOR(down))

    def folded(d: DataFrame, by: int) -> DataFrame:
        return d.withColumn("_z", F.col("_z").bitwiseXOR(F.shiftrightunsigned("_z", by)))

    def mixed(d: DataFrame) -> DataFrame:
        return folded(times(folded(times(folded(d, 30), 0xBF58476D1CE4E5B9), 27), 0x94D049BB133111EB), 31)

    d = mixed(df.withColumn("_z", F.col(tag).cast("long")))
    d = mixed(d.withColumn("_z", F.col("_z").bitwiseXOR(F.lit(_word(root))))).withColumnRenamed("_z", "_s")
    d = times(d.withColumn("_z", F.col(counter).cast("long") + 1), 0x9E3779B97F4A7C15)
    low = F.col("_s").bitwiseAND(mask) + F.col("_z").bitwiseAND(mask)
    d = d.withColumn("_l", low).withColumn("_h", F.shiftrightunsigned("_s", 32) + F.shiftrightunsigned("_z", 32) + F.shiftrightunsigned("_l", 32))
    d = mixed(d.withColumn("_z", F.shiftleft(F.col("_h").bitwiseAND(mask), 32).bitwiseOR(F.col("_l").bitwiseAND(mask))))
    return d.select(*df.columns, F.col("_z").alias(out))


def unit_f64(word: Column) -> Column:
    return F.shiftrightunsigned(word, 11).cast("double") * F.lit(2.0**-53)


def uniform_f32(seed: Column, counter: Column, low: float, high: float) -> Column:
    """Affine in double precision, rounded once to single."""
    return (F.lit(float(low)) + unit_f64(draw(seed, counter)) * F.lit(float(high) - float(low))).cast("float")


def hex64(word: Column) -> Column:
    return F.lpad(F.hex(word), 16, "0")


def draw_int(seed: int, counter: int) -> int:
    """``draw`` on Python integers, for the driver and for tests."""
    return mix_int(seed + (counter + 1) * 0x9E3779B97F4A7C15 & _M64)


def mix_int(z: int) -> int:
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M64
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _M64
    return z ^ z >> 31


def derive_int(seed: int, tag: int) -> int:
    return mix_int(seed ^ mix_int(tag))
