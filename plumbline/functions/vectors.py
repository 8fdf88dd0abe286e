"""Probability vectors as native array expressions: no vector ever leaves the JVM.

Vectors take their length from the row, never a constant. NaN never enters: clips replace it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest probability, and the logit of a letter without a score.
EPSILON = 1e-12
MISSING_LOGIT = -30.0
MISSING_PRIOR = 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the optimiser inlines columns, but not the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    """Sum of a vector, from the left."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def normalised(v: Column) -> Column:
    """Divide by the sum; a sum of 0 or less gives the uniform vector."""
    share = lambda p: F.when(p["s"] > 0, F.transform(p["v"], lambda x: x / p["s"])).otherwise(F.transform(p["v"], lambda x: F.lit(1.0) / F.size(p["v"])))
    return let(v, lambda w: let(F.struct(w.alias("v"), total(w).alias("s")), share))


def clipped(v: Column, least: float = EPSILON) -> Column:
    """Every element within [least, 1]; NaN and null count as least."""
    return F.transform(v, lambda x: F.least(F.greatest(F.nanvl(F.coalesce(x, F.lit(least)), F.lit(least)), F.lit(least)), F.lit(1.0)))


def softmax(v: Column) -> Column:
    """Softmax with the largest element taken off first."""
    powers = lambda w: let(F.array_max(w), lambda top: F.transform(w, lambda x: F.exp(x - top)))
    return let(v, lambda w: let(powers(w), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))))


def label_distribution(logits: Column) -> Column:
    """Distribution over a row's letters from its scores: softmax, clip, normalise; a null score is -30; fewer than two letters give null."""
    filled = F.transform(logits, lambda x: F.coalesce(x, F.lit(MISSING_LOGIT)))
    return F.when(F.size(logits) >= 2, normalised(clipped(softmax(filled))))


def square(m: Column) -> Column:
    """Whether a matrix has as many columns as rows in every row, and at least two."""
    return (F.size(m) >= 2) & F.forall(m, lambda r: F.size(r) == F.size(m))


def prior_from_rollouts(m: Column) -> Column:
    """Position prior of a question: softmax over positions of the mean log probability over rotations (Eq. 7)."""
    logs = lambda w: F.transform(w, lambda r: F.transform(clipped(r), lambda x: F.log(x)))
    means = lambda w: let(logs(w), lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda j: F.aggregate(g, F.lit(0.0), lambda a, r: a + F.get(r, j)) / F.size(g)))
    return let(m, lambda w: F.when(square(w), softmax(means(w))))


def content_probabilities(m: Column) -> Column:
    """Probability of each content: mean over rotations k of P[k, (c - k) mod n], normalised if positive (Eq. 1)."""
    def mass(w: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(w) - 1)
        return F.transform(positions, lambda c: F.aggregate(positions, F.lit(0.0), lambda a, k: a + F.get(F.get(w, k), F.pmod(c - k, F.size(w)).cast("int"))) / F.size(w))

    return let(m, lambda w: F.when(square(w), let(mass(w), lambda v: F.when(total(v) > 0, normalised(v)).otherwise(v))))


def debiased(observed: Column, prior: Column, least: float = EPSILON) -> Column:
    """Observed over prior, both clipped from below, normalised; null unless the lengths agree and are at least two (Eq. 8)."""
    floor = lambda v: F.transform(v, lambda x: F.greatest(x, F.lit(least)))
    ratio = lambda b: F.zip_with(floor(b["o"]), floor(b["p"]), lambda o, p: o / p)
    fits = lambda b: (F.size(b["o"]) == F.size(b["p"])) & (F.size(b["o"]) >= 2)
    return let(F.struct(observed.alias("o"), prior.alias("p")), lambda b: F.when(fits(b), normalised(ratio(b))))


def first_max(v: Column) -> Column:
    """0-based position of the first largest element."""
    return let(v, lambda w: (F.array_position(w, F.array_max(w)) - 1).cast("int"))


def restricted_prior(prior: Column, labels: Column) -> Column:
    """A prior map restricted to a row's letters, in their order: missing letters get 1e-6; a null map is uniform."""
    return F.when(prior.isNull(), F.transform(labels, lambda x: F.lit(1.0) / F.size(labels))).otherwise(
        normalised(F.transform(labels, lambda x: F.greatest(F.coalesce(F.try_element_at(prior, x), F.lit(MISSING_PRIOR)), F.lit(EPSILON))))
    )


def debiased_choice(logits: Column, prior: Column, labels: Column) -> Column:
    """The letter of the first largest debiased probability of a row."""
    return F.get(labels, first_max(debiased(label_distribution(logits), restricted_prior(prior, labels))))


def parse_matrix(text: Column) -> Column:
    """A JSON matrix; null for malformed, ragged, empty or non-numeric input."""
    m = F.from_json(text, "array<array<double>>")
    good = (F.size(m) > 0) & F.forall(m, lambda r: r.isNotNull() & (F.size(r) > 0) & (F.size(r) == F.size(F.get(m, F.lit(0)))) & F.forall(r, lambda x: x.isNotNull()))
    return F.when(good, m)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 where it is undefined."""
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.nanvl(F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(-1.0)), F.lit(-1.0))


def paired_forms(logits: Column) -> Column:
    """Softmax over two token forms of each letter (first halves, then second halves), forms added up."""
    half = (F.size(logits) / 2).cast("int")
    return F.when(F.size(logits) % 2 == 0, let(softmax(logits), lambda p: F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda x, y: x + y)))


def top_two_tie(v: Column) -> Column:
    """Whether the two largest elements are exactly equal."""
    return let(F.sort_array(v, asc=False), lambda s: (F.size(s) >= 2) & (F.get(s, F.lit(0)) == F.get(s, F.lit(1))))
