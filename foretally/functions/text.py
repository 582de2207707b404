"""Text forms: number text, canonical JSON, fingerprints, slugs, tuple text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def g12(x: Column) -> Column:
    """A number with 12 significant digits and no trailing zeros (the usual %.12g text)."""
    strip = lambda c: F.regexp_replace(c, r"0+$", "")
    join = lambda left, right: F.when(right == "", left).otherwise(F.concat(left, F.lit("."), right))

    def lay_out(sci):
        digits = F.concat(F.substring(sci, 1, 1), F.substring(sci, 3, 11))
        exp = F.substring_index(sci, "e", -1).cast("int")
        whole = join(F.substr(digits, F.lit(1), exp + 1), strip(F.substr(digits, exp + 2)))
        small = join(F.lit("0"), strip(F.concat(F.repeat(F.lit("0"), -exp - 1), digits)))
        tail = F.concat(F.when(exp < 0, "e-").otherwise("e+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
        power = F.concat(join(F.substring(digits, 1, 1), strip(F.substring(digits, 2, 11))), tail)
        return F.when((exp >= 0) & (exp < 12), whole).when((exp < 0) & (exp >= -4), small).otherwise(power)

    # a one-element array binds the formatted text, so it is made once per value
    text = F.transform(F.array(F.format_string("%.11e", F.abs(x))), lay_out)[0]
    special = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").when(x == 0, "0")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.coalesce(special, text))


def canonical_json(fields: dict) -> Column:
    """JSON text with sorted keys; doubles as 12-digit text, missing values as null.

    ``fields`` maps a name to (column, kind) with kind in text, number, float, floats, raw.
    """
    parts = []
    for name in sorted(fields):
        c, kind = fields[name]
        quote = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
        if kind == "text":
            value = F.to_json(F.struct(c.alias("v")))  # JSON escaping of the text
            value = F.regexp_extract(value, r'^\{"v":(.*)\}$', 1)
        elif kind == "float":
            value = quote(g12(c))
        elif kind == "floats":
            value = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: quote(g12(v))), ","), F.lit("]"))
        else:
            value = c.cast("string")
        value = F.when(c.isNull(), F.lit("null")).otherwise(value)
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprint(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def row_digest(*parts: Column) -> Column:
    """60 bits of a hash of the row's text: rows of a table add up to an order-free checksum."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def content_checksum(df: DataFrame, keys, parts) -> DataFrame:
    """Order-free content checksum per key from per-row digests (partial sums first)."""
    total = F.sum(row_digest(*parts)).cast("string")
    return df.groupBy(*keys).agg(fingerprint(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total)).alias("checksum"))


def slug(label: Column) -> Column:
    """Label to a file-safe name: blanks and slashes to underscores, brackets dropped."""
    return F.lower(F.regexp_replace(F.regexp_replace(label, r"[()=,]", ""), r"[\s/#-]+", "_"))


def number_list(text: Column) -> Column:
    """'(0.6, 0.2, 0.2)' to an array of doubles; a bad entry becomes NULL, nothing is evaluated."""
    inner = F.regexp_replace(text, r"[()\[\]\s]", "")
    return F.transform(F.split(inner, ","), lambda v: v.try_cast("double"))


def close_to(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
