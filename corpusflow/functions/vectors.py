"""Vector expressions for single pairs.

Tables of questions are scored by ``operators.retrieval`` in matrix blocks;
these expressions serve row-wise use and ad-hoc questions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(vector: Column) -> Column:
    """ARRAY<FLOAT> to text of the form ``[0.1, 0.2]``."""
    items = F.transform(vector, lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def decode(text: Column) -> Column:
    """Text of the form ``[0.1, 0.2]`` to ARRAY<FLOAT>.

    Null, empty or damaged text gives an empty vector.  Empty items at the end
    do not count as damage.
    """
    inner = F.regexp_replace(text.substr(F.lit(2), F.length(text) - 2), "(, )+\\z", "")
    parsed = F.transform(F.split(inner, ", "), lambda x: x.try_cast("float"))
    damaged = F.exists(parsed, lambda x: x.isNull())
    empty = F.array().cast("array<float>")
    usable = text.isNotNull() & (F.length(text) > 2) & ~damaged
    return F.when(usable, parsed).otherwise(empty)


def is_usable(vector: Column) -> Column:
    """A vector that came out of a successful encoding."""
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column, norm2_a: Column | None = None, norm2_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for unequal widths and for zero vectors.

    Squared norms kept with the vectors may be passed in.
    """
    na = squared_norm(a) if norm2_a is None else norm2_a
    nb = squared_norm(b) if norm2_b is None else norm2_b
    comparable = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(comparable, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences; null for unequal widths."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def distance_score(distance: Column) -> Column:
    """Similarity 1/(1+d) of a distance."""
    return F.lit(1.0) / (F.lit(1.0) + distance)
