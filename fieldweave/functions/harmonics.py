"""Real solid harmonics up to order 5 and the choice of terms for encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 36 polynomials, term 1 first, in Horner-free SQL; r2 is x*x+y*y+z*z.
TERMS = (
    "1.0", "x", "y", "z",
    "x*y", "z*y", "3*z*z-r2", "x*z", "x*x-y*y",
    "3*y*x*x-y*y*y", "x*y*z", "(5*z*z-r2)*y", "5*z*z*z-3*z*r2", "(5*z*z-r2)*x", "x*x*z-y*y*z", "x*x*x-3*x*y*y",
    "x*y*(x*x-y*y)", "y*z*(3*x*x-y*y)", "x*y*(7*z*z-r2)", "y*(7*z*z*z-3*z*r2)", "35*z*z*z*z-30*z*z*r2+3*r2*r2",
    "x*(7*z*z*z-3*z*r2)", "(x*x-y*y)*(7*z*z-r2)", "x*z*(x*x-3*y*y)", "x*x*(x*x-3*y*y)-y*y*(3*x*x-y*y)",
    "y*(5*x*x*x*x-10*x*x*y*y+y*y*y*y)", "x*y*z*(x*x-y*y)", "y*(r2-9*z*z)*(y*y-3*x*x)", "x*y*z*(3*z*z-r2)",
    "y*(r2*r2-14*r2*z*z+21*z*z*z*z)", "63*z*z*z*z*z-70*z*z*z*r2+15*z*r2*r2", "x*(r2*r2-14*r2*z*z+21*z*z*z*z)",
    "z*(3*z*z-r2)*(x*x-y*y)", "x*(r2-9*z*z)*(3*y*y-x*x)", "z*(x*x*x*x-6*x*x*y*y+y*y*y*y)", "x*x*x*x*x-10*x*x*x*y*y+5*x*y*y*y*y",
)
#: First term of each order, and one past the last.
ORDER_FROM = (1, 2, 5, 10, 17, 26, 37)


def term(number: int) -> Column:
    """Term ``number`` (from 1) of columns x, y, z."""
    if not 1 <= number <= len(TERMS):
        raise ValueError(f"no term {number}")
    return F.expr(TERMS[number - 1].replace("r2", "(x*x+y*y+z*z)")).cast("double")


def terms(numbers) -> Column:
    return F.array(*[term(n) for n in numbers])


def select_orders(k: Column, nominal: Column, n_terms: int, orders: str) -> Column:
    """Coefficients with the orders whose digit in ``orders`` is 0 set to zero.

    For order 1 the nominal coefficients stand in instead.  ``orders`` has a digit for each order
    (3 for 9 terms, 4 for 16).
    """
    if n_terms not in (9, 16) or len(orders) != {9: 3, 16: 4}[n_terms] or set(orders) - {"0", "1"}:
        raise ValueError(f"orders {orders!r} do not fit {n_terms} terms")
    out = []
    for n in range(1, n_terms + 1):
        order = next(i for i in range(len(ORDER_FROM)) if n < ORDER_FROM[i + 1])
        kept = k[n - 1]
        other = nominal[n - 1] if order == 1 else F.lit(0.0)
        out.append(kept if orders[order] == "1" else other)
    return F.array(*out)


def with_concomitant(basis: Column, x: Column, y: Column, z: Column) -> Column:
    """The basis and its four concomitant terms z^2, x^2 + y^2, x z, y z."""
    return F.concat(basis, F.array(z * z, x * x + y * y, x * z, y * z))


def near_square_factors(n: Column) -> Column:
    """(a, b) with a * b = n, a <= b, as near to each other as can be."""
    small = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.ceil(F.sqrt(n)).cast("long")), lambda a: (n % a == 0) & (a * a <= n)))
    return F.struct(small.alias("a"), (n / small).cast("long").alias("b"))


def term_metadata(spark):
    """(term, name, field_order, unit, integrated_unit, expression) of the 16 terms used for encoding.

    Units follow from the order: tesla over metres to the order, and its integral in cycles.
    """
    powers = "⁰¹²³"
    rows = []
    for n in range(1, 17):
        order = next(i for i in range(len(ORDER_FROM)) if n < ORDER_FROM[i + 1])
        unit = "T" if order == 0 else "T/m" if order == 1 else f"T/m{powers[order]}"
        rows.append((n, f"h{n - 1}", order, unit, f"m⁻{powers[order]}" if order else "", TERMS[n - 1]))
    return spark.createDataFrame(rows, "term int, name string, field_order int, unit string, integrated_unit string, expression string")
