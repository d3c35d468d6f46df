"""Growth-class labels as Column expressions: spelling, folding, order, evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Canonical classes, their order, and spellings of each (small letters, without spaces and the outer O()).
CLASSES = ["O(1)", "O(log n)", "O(sqrt n)", "O(n)", "O(n log n)", "O(n^2)", "O(2^n)", "O(n!)", "O(V + E)"]
SPELLINGS = {
    "O(1)": ["1", "constant", "o(1)", "t(n-1)", "o(t(n-1))", "t(n/2)", "o(t(n/2))", "t(n-2)", "o(t(n-2))"],
    "O(n)": ["n", "linear", "o(n)"],
    "O(n^2)": ["n^2", "quadratic", "o(n^2)", "n*m", "nm", "m*n", "o(n*m)"],
    "O(n^3)": ["n^3", "cubic", "o(n^3)"],
    "O(n^4)": ["n^4", "quartic", "o(n^4)"],
    "O(n log n)": ["nlogn", "n*logn", "log(n)*n", "o(nlogn)"],
    "O(log n)": ["logn", "log(n)", "log", "o(logn)"],
    "O(sqrt n)": ["sqrtn", "sqrt(n)", "sqrt", "n^0.5", "o(sqrtn)"],
    "O(V + E)": ["v+e", "e+v", "v", "e", "o(v+e)"],
    "O(n^2 log n)": ["n^2logn", "n*n*logn", "o(n^2logn)"],
    "O(n!)": ["n!", "factorial", "o(n!)"],
    "O(n * n!)": ["n*n!", "o(n*n!)"],
    "O(2^n)": ["2^n", "exponential", "o(2^n)", "o(exponential)"],
    "O(3^n)": ["3^n", "o(3^n)"],
}
RECURRENCES = {
    "T(n) = T(n/2) + O(1)": "O(log n)",
    "T(n) = 2T(n/2) + O(n)": "O(n log n)",
    "T(n) = T(n-1) + O(1)": "O(n)",
    "T(n) = T(n-1) + O(n)": "O(n^2)",
    "T(n) = T(n-1) + T(n-2) + O(1)": "O(2^n)",
    "T(n) = n * T(n-1)": "O(n!)",
    "T(n) = 2T(n/2) + O(1)": "O(n)",
    "T(n) = T(n/2) + O(n)": "O(n)",
    "T(n) = T(n-1) + O(log n)": "O(n log n)",
}
PASSTHROUGH = ["", "-", "MISSING", "PARSE_FAIL", "ERROR"]

#: Names of classes inside O().
NAMED = {"o(constant)": "o(1)", "o(cubic)": "o(n^3)", "o(quartic)": "o(n^4)", "o(exponential)": "o(2^n)"}
#: Letters that stand for one size as n does.
SIZE_LETTERS = "kmpqrs"


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once; a plain expression would repeat it wherever it is named."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


#: Distinct labels that ``once`` works out ahead, at most.
MOST_LABELS = 256


def once(df: DataFrame, columns: dict[str, str], rule: Callable[[Column], Column], labels: DataFrame | None = None, most: int = MOST_LABELS) -> DataFrame:
    """Add ``rule`` of label columns (new name: column), worked out once for each of ``most`` distinct labels.

    The labels are those of ``labels`` (``df`` itself by default, whose labels they must hold). Up to ``most`` of them, null with them,
    are worked out in a job of their own, so that the rule is not part of the plan that follows, and looked up by broadcast joins that move no
    fact. With more labels, the first ``most`` are looked up and a row with any further label has the rule worked out where it is. So the
    broadcast is bounded and the result does not depend on it.
    """
    label, used = F.col("label"), [F.col(c) for c in columns.values()]
    met = (df if labels is None else labels).select(F.explode(F.array_distinct(F.array(*columns.values()))).alias("label")).where(label.isNotNull()).distinct().limit(most + 1)
    null = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("label"))
    few = cut(met.unionByName(null).select("label", rule(label).alias("value")))
    whole = few.count() <= most + 1
    few = few if whole else few.where(label.isNotNull()).limit(most)
    for i, c in enumerate(used):
        named = few.select(label.alias(f"__label{i}"), F.col("value").alias(f"__value{i}"))
        df = df.join(F.broadcast(named), c.eqNullSafe(F.col(f"__label{i}")) if whole else c == F.col(f"__label{i}"), "left")
    if whole:
        found = {name: F.col(f"__value{i}") for i, name in enumerate(columns)}
        return df.withColumns(found).drop(*[f"__{part}{i}" for i in range(len(used)) for part in ("label", "value")])
    unknown = reduce(lambda a, b: a | b, [c.isNotNull() & F.col(f"__value{i}").isNull() for i, c in enumerate(used)])
    df = df.withColumn("__rest", F.when(unknown, F.transform(F.array(*used), rule)))
    none = rule(F.lit(None).cast("string"))
    found = {name: F.when(c.isNull(), none).otherwise(F.coalesce(F.col(f"__value{i}"), F.col("__rest")[i])) for i, (name, c) in enumerate(zip(columns, used, strict=True))}
    return df.withColumns(found).drop("__rest", *[f"__{part}{i}" for i in range(len(used)) for part in ("label", "value")])


def resolve_recurrence(c: Column) -> Column:
    """The class that a recurrence solves to; other labels as they are."""
    return F.coalesce(F.element_at(_lookup(RECURRENCES), c), c)


def normalize(c: Column) -> Column:
    """Canonical spelling of a label; ``-`` for null, empty or ``-``."""
    spelled = {s: name for name, ways in SPELLINGS.items() for s in ways}
    bare = lambda s: F.when(s.startswith("o(") & s.endswith(")"), F.substring(s, F.lit(3), F.length(s) - 3)).otherwise(s)
    named = lambda s: F.coalesce(F.element_at(_lookup(spelled), s), F.concat(F.lit("O("), s, F.lit(")")))
    squeezed = F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit(""))
    # labels in canonical spelling, the most common by far, are left before any work
    return F.when(c.isNull() | c.isin("", "-"), F.lit("-")).when(c.isin(*SPELLINGS), c).otherwise(let(let(squeezed, bare), named))


def fold(c: Column) -> Column:
    """A polynomial over several size letters expressed in n; anything else unchanged.

    The degree of a term is the sum of its exponents; the largest of the terms without
    the edge letter counts. The edge letter alone, or beside degree 1, is left.
    """
    def degree(t: Column) -> Column:
        power = lambda f: F.when(f.rlike(r"^\d+$") | f.rlike(r"^e"), F.lit(0)).otherwise(F.coalesce(F.nullif(F.regexp_extract(f, r"\^(\d+)$", 1), F.lit("")).cast("int"), F.lit(1)))
        return F.aggregate(F.split(t, r"\*"), F.lit(0), lambda acc, f: acc + power(f))

    with_edge = lambda t: F.exists(F.split(t, r"\*"), lambda f: f.rlike(r"^e(\^\d+)?$"))

    def polynomial(terms: Column) -> Column:
        """Struct of whether an edge letter occurs and of the largest degree without one."""
        tops = F.transform(F.filter(terms, lambda t: ~with_edge(t)), degree)
        return F.struct(F.exists(terms, with_edge).alias("edge"), F.coalesce(F.array_max(tops), F.lit(0)).alias("top"))

    def named(s: Column) -> Column:
        return lambda p: (
            F.when(p["edge"] & (p["top"] < 2), s)
            .when(p["top"] == 0, F.lit("O(1)"))
            .when(p["top"] == 1, F.lit("O(n)"))
            .otherwise(F.concat(F.lit("O(n^"), p["top"].cast("string"), F.lit(")")))
        )

    def folded(s: Column) -> Column:
        compact = F.replace(s, F.lit(" "), F.lit(""))
        body = F.regexp_extract(F.lower(compact), r"^o\(([a-z0-9^*+]+)\)$", 1)
        fits = lambda x: F.forall(F.split(x, r"[+*]"), lambda f: f.rlike(r"^(\d+|[a-z](\^\d+)?)$"))
        return (
            F.when(compact.contains("V+E") | compact.contains("E+V"), F.lit("O(V + E)"))
            .when(s.isin(*CLASSES, *PASSTHROUGH), s)
            .otherwise(let(body, lambda x: F.when((x == "") | ~fits(x), s).otherwise(let(polynomial(F.split(x, r"\+")), named(s)))))
        )

    return F.when(c.isNull() | c.isin(*CLASSES, *PASSTHROUGH), c).otherwise(let(F.trim(c), folded))


def canonical(c: Column) -> Column:
    """A label spelled and folded; two labels are the same class where these are equal."""
    return fold(normalize(c))


def agree(actual: Column, expected: Column, same: Column) -> Column:
    """Whether a prediction counts as right: no expectation passes, no prediction fails, else whether the classes are the ``same``."""
    absent = lambda c: c.isNull() | c.isin("", "-")
    return F.when(absent(expected), F.lit(True)).when(absent(actual), F.lit(False)).otherwise(same)


def matches(actual: Column, expected: Column) -> Column:
    """The same for two labels, which are of one class if equal once spelled and folded alike."""
    return agree(actual, expected, canonical(actual) == canonical(expected))


def growth(c: Column) -> Column:
    """What a label grows like, as a struct; recurrences are resolved first.

    ``kind`` is poly, exp, fact or unknown. Of the term that grows most: ``degree`` (the sum of its exponents),
    ``log_power`` and ``letters`` (how many factors have a size letter). Of the whole: ``base`` of an
    exponential, ``sizes`` (its letters in order), ``power`` (the largest exponent of n), ``terms``, whether
    all terms can be ``read``, and whether it is ``wrapped`` in O().
    """
    factor = r"[a-z](?:\^\d+(?:\.\d+)?)?"

    def term(t: Column) -> Column:
        """One summand; a logarithm is taken out, a root is an exponent of a half."""
        rest = F.regexp_replace(F.regexp_replace(t, r"\*?log(\(?[a-z]\)?)?", ""), r"^\*", "")
        rest = F.regexp_replace(rest, r"sqrt(?:\(([a-z])\)|([a-z])|$)", "$1$2^0.5")
        rest = F.when(rest == "^0.5", "n^0.5").otherwise(rest)
        return F.struct(rest.rlike(f"^({factor}(\\*{factor})*)?$").alias("read"), F.least(F.regexp_count(t, F.lit("log")), F.lit(1)).alias("logs"), F.regexp_extract_all(rest, F.lit(f"({factor})"), 1).alias("factors"))

    exponent = lambda f: F.coalesce(F.try_element_at(F.split(f, r"\^"), F.lit(2)).cast("double"), F.lit(1.0))
    degree = lambda fs: F.aggregate(fs, F.lit(0.0), lambda total, f: total + exponent(f))

    def fields(s: Column, text: Column) -> Column:
        base = F.replace(F.nullif(F.regexp_extract(text, r"(\d+|c)\^n", 1), F.lit("")), F.lit("c"), F.lit("2")).cast("double")

        def whole(terms: Column) -> Column:
            read = F.filter(terms, lambda t: t["read"] & ((F.size(t["factors"]) > 0) | (t["logs"] > 0)))
            factors = F.flatten(read["factors"])
            main = F.array_max(F.transform(read, lambda t: F.struct(degree(t["factors"]).alias("degree"), t["logs"].alias("logs"), F.size(t["factors"]).alias("letters"))))
            kind = F.when(text.contains("n!"), "fact").when(base.isNotNull(), "exp").when(main.isNotNull() | (text == "1"), "poly").otherwise("unknown")
            return F.struct(
                kind.alias("kind"), F.when(text == "1", 0.0).otherwise(main["degree"]).alias("degree"), F.coalesce(main["logs"], F.when(text.contains("log"), 1), F.lit(0)).alias("log_power"), base.alias("base"),
                F.coalesce(main["letters"], F.lit(0)).alias("letters"), F.array_join(F.array_sort(F.array_distinct(F.transform(factors, lambda f: F.substring(f, 1, 1)))), "").alias("sizes"),
                F.array_max(F.transform(F.filter(factors, lambda f: f.startswith("n")), exponent)).alias("power"), F.size(terms).alias("terms"), F.forall(terms, lambda t: t["read"]).alias("read"), (s != text).alias("wrapped"),
            )

        return let(F.transform(F.split(text, r"\+"), term), whole)

    squeezed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    for sign, plain in (("²", "^2"), ("³", "^3"), ("ⁿ", "^n"), ("√", "sqrt")):
        squeezed = F.replace(squeezed, F.lit(sign), F.lit(plain))
    tight = lambda label: label.lower().replace(" ", "")
    solved = _lookup({tight(k): tight(v) for k, v in RECURRENCES.items()})
    return let(F.coalesce(F.element_at(solved, squeezed), squeezed), lambda s: let(F.coalesce(F.nullif(F.regexp_extract(s, r"^o\((.*)\)$", 1), F.lit("")), s), lambda text: fields(s, text)))


def _in_n(g: Column) -> Column:
    """The exponent of n, or the degree of n or of a product of letters; other letters are not read as sizes of their own."""
    return F.when(g["power"] > 1, g["power"]).when(g["sizes"].contains("n") | (g["letters"] > 1), g["degree"])


def _alone(g: Column, letters: str) -> Column:
    """Whether the label is one of these letters."""
    return (g["terms"] == 1) & (g["letters"] == 1) & (g["degree"] == 1) & (g["log_power"] == 0) & g["sizes"].isin(*letters)


def weight(c: Column, default: int = 0) -> Column:
    """Ordinal 1 (constant) to 9 (factorial) of a label, ``default`` where nothing fits."""

    def by_growth(g: Column) -> Column:
        linear_log = (_in_n(g) == 1) & (g["log_power"] > 0)
        pair = g["wrapped"] | g["sizes"].rlike("mn|ev")
        return (
            F.when(g["kind"] == "fact", 9)
            .when(g["kind"] == "exp", F.when(g["base"] == 2, 8))
            .when((F.floor(g["power"]) == 2) | (g["letters"] > 1), 7)
            .when(g["read"] & (g["terms"] > 1) & (g["log_power"] == 0) & pair, 5)
            .when(linear_log, 6)
            .when(g["wrapped"] & _alone(g, "nm"), 4)
            .when(g["degree"] == 0.5, 3)
            .when(g["log_power"] > 0, 2)
            .when(g["wrapped"] & (g["degree"] == 0), 1)
        )

    return F.coalesce(let(growth(c), by_growth), F.lit(default))


def bucket(c: Column) -> Column:
    """Growth class name of a label; without O() it is unknown."""

    def by_growth(g: Column) -> Column:
        d, logs = _in_n(g), g["log_power"] > 0
        poly = (
            F.when((d > 2) | ((d == 2) & logs & (g["letters"] == 1)), "polyHigh")
            .when(d == 2, "quadratic")
            .when((d > 1) | ((d == 1) & logs), "nlogn")
            .when((g["degree"] > 0) & (g["degree"] < 1), "sqrt")
            .when(_alone(g, "ve") | ((g["degree"] == 1) & (g["terms"] > 1) & g["sizes"].rlike("mn|ev")), "graph")
            .when((g["terms"] == 1) & (g["degree"] == 1) & ~logs, "linear")
            .when(logs, "log")
            .when((g["terms"] == 1) & (g["degree"] == 0), "constant")
        )
        found = F.when(g["kind"] == "fact", "factorial").when(g["kind"] == "exp", "exponential").otherwise(poly)
        return F.coalesce(F.when(g["wrapped"], found), F.lit("unknown"))

    tight = F.regexp_replace(F.lower(c), r"\s+", "")
    return let(growth(F.coalesce(F.element_at(_lookup(NAMED), tight), c)), by_growth)


def _ladder(d: Column, logs: Column) -> Column:
    """Rank of a power of n times a logarithm: 10, 20, then 6 a degree up to 90, with room for the logarithm between."""
    whole = F.floor(d)
    return F.when(whole >= 2, F.least(8 + 6 * whole, F.lit(90)) + logs * F.when(whole == 2, 5).otherwise(1)).when(whole == 1, 10 + 5 * logs)


def rank(c: Column) -> Column:
    """Finer ordinal of a canonical label, for the dominating line of a program."""

    def by_growth(g: Column) -> Column:
        d, logs = g["degree"], g["log_power"]
        lone = (g["terms"] == 1) & (g["letters"] == 1) & g["sizes"].isin(*SIZE_LETTERS)
        return (
            F.when(g["kind"] == "fact", 150)
            .when(g["kind"] == "exp", F.when(g["base"] == 2, 100).otherwise(10))
            .when(g["letters"] > 1, 8 + 6 * d - 0.5)
            .when(g["sizes"].contains("v"), 10 + 2 * d)
            .when(g["power"].isNotNull() | lone, F.coalesce(_ladder(d, logs), F.lit(7)))
            .when(g["letters"] > 0, 0)
            .when(logs > 0, 5)
            .when(g["wrapped"] & (d == 0), 1)
        )

    return F.coalesce(F.when(c == "Dead Code", -1).when(c == "Definition", 1).otherwise(let(growth(c), by_growth)), F.lit(0)).cast("double")


def space_rank(c: Column) -> Column:
    """The same for memory."""

    def by_growth(g: Column) -> Column:
        power = F.when(g["power"] >= 3, 2.5).when(g["power"] >= 2, 2.0)
        rest = F.when(g["sizes"].contains("v"), 3.0).when(g["degree"] == 0.5, 0.7).when((g["log_power"] > 0) & (g["power"].isNotNull() | (g["letters"] == 0)), 0.5).when(g["power"].isNotNull(), 1.0)
        return F.when(g["kind"] == "fact", 5.0).when(g["kind"] == "exp", F.when(g["base"] == 2, 4.0).otherwise(1.0)).otherwise(F.coalesce(power, rest))

    return F.coalesce(let(growth(c), by_growth), F.lit(0.0))


def _shape(c: Column, f) -> Column:
    """``f`` of the growth of a class that has one term over n, or over the parts of a graph; null for other labels and for recurrences."""

    def known(g: Column) -> Column:
        plain = (g["terms"] == 1) & (g["sizes"].isin("", "n", "v") | (g["sizes"] == "m") & (g["degree"] == 1) | (g["letters"] > 1))
        graph = (g["sizes"] == "ev") & (g["degree"] == 1)
        return F.when(g["wrapped"] & (plain | graph | (g["kind"] == "fact")), f(g))

    return F.when(~F.lower(c).contains("t("), let(growth(c), known))


def growth_eval(c: Column, n: Column) -> Column:
    """Step count of a label at size n; null for a label without a known shape, and for a factorial past 20."""
    x = n.cast("double")
    beside = F.when(F.replace(F.lower(c), F.lit(" "), F.lit("")).contains("n*n!"), x).otherwise(1.0)
    return _shape(
        c,
        lambda g: F.when(g["kind"] == "fact", F.when(n <= 20, F.factorial(F.least(n, F.lit(20)).cast("int")) * beside))
        .when(g["kind"] == "exp", F.pow(g["base"], x))
        .when(g["kind"] == "poly", F.pow(x, g["degree"]) * F.pow(F.log2(F.greatest(x, F.lit(2.0))), g["log_power"].cast("double"))),
    )


def practical_limit(c: Column, budget: float = 1e7) -> Column:
    """Largest n whose step count stays within the budget; null where all or none do.

    Powers have a closed form, corrected by one where rounding misses; powers times a
    logarithm are bisected over the doublings below the budget; exponentials and
    factorials are looked up over the few sizes that fit.
    """
    doublings = F.array(*[F.lit(2**k).cast("long") for k in range(int(math.log2(budget)) + 1, -1, -1)])
    fact = max(k for k in range(1, 21) if math.factorial(k) <= budget)

    def largest(g: Column) -> Column:
        root = F.floor(F.pow(F.lit(budget), 1 / g["degree"]))
        root = root + F.when(F.pow((root + 1).cast("double"), g["degree"]) <= budget, 1).otherwise(0)
        steps = lambda x: F.pow(x.cast("double"), g["degree"]) * F.log2(x.cast("double"))
        search = F.aggregate(doublings, F.lit(1).cast("long"), lambda acc, d: F.when(steps(acc + d) <= budget, acc + d).otherwise(acc))
        powers = F.floor(F.log(F.lit(budget)) / F.log(g["base"]) + F.lit(1e-9))
        poly = F.when(g["degree"] > 0, F.when(g["log_power"] > 0, search).otherwise(root))
        return F.when(g["kind"] == "fact", F.lit(fact)).when(g["kind"] == "exp", powers).when(g["kind"] == "poly", poly).cast("long")

    return _shape(c, largest)
