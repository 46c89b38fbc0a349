"""Problem 1: mixed timestamp formats and zones to one unambiguous instant.

Expectation-maximisation over format mixtures per source. Each value has the interpretations under
which its text is a possible date: ``dmy`` and ``mdy`` for all-number dates, a single one for any other
notation. A value adds to the likelihood of each valid interpretation, weighted by how plausible the
instant is against the time of arrival; the E-step spreads it over the interpretations by the current
mixture of its source, the M-step sets the mixture to the mean responsibility. Values enter the EM as
counts per (source, signature) and a signature is two small numbers per interpretation, so that what is
kept of a source is bounded by the number of signatures and not by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentia.functions import instants as I

#: Mixture iterations; the two-component mixtures used here converge well before.
EM_STEPS = 24
#: Pseudo-count of each interpretation.
PRIOR = 0.5
#: Posterior from which an undeclared order is taken as resolved.
RESOLVED = 0.95
#: Likelihood of an instant outside the plausible span before its arrival, against 1 inside.
IMPLAUSIBLE = 0.05
PLAUSIBLE_DAYS = (-2, 60)
#: Salts for rows that need no mixture, so that they don't meet in one partition of the join.
SALTS = 256
ALL_NUMBER = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"


def mixtures(values: DataFrame) -> DataFrame:
    """(source, p_dmy) from rows of (source, like_dmy, like_mdy): EM on counts per signature."""
    signatures = values.groupBy("source", "like_dmy", "like_mdy").agg(F.count("*").cast("double").alias("n"))
    # few signatures a source: likelihoods are 0, IMPLAUSIBLE or 1
    per_source = signatures.groupBy("source").agg(F.collect_list(F.struct("like_dmy", "like_mdy", "n")).alias("sig"), F.sum(F.when(F.col("like_dmy") + F.col("like_mdy") > 0, F.col("n")).otherwise(0.0)).alias("total"))

    def step(p: Column, _: Column) -> Column:
        share = lambda s: s["n"] * p * s["like_dmy"] / (p * s["like_dmy"] + (1 - p) * s["like_mdy"])
        expected = F.aggregate("sig", F.lit(0.0), lambda acc, s: acc + F.when(s["like_dmy"] > 0, share(s)).otherwise(0.0))
        return (expected + PRIOR) / (F.col("total") + 2 * PRIOR)

    return per_source.select("source", F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), F.lit(0.5), step).alias("p_dmy"))


def _readings(given: DataFrame, known: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the instants ``dmy``, ``mdy`` and ``epoch`` of their text, each null where impossible."""
    # one projection a step: the optimizer merges none whose result is used more than once
    rows = given.select("key", "named", F.coalesce("named", F.lit("")).alias("source"), F.col("text").rlike(I.CANONICAL).alias("own"), I.clean_text(F.col("text")).alias("cleaned"), "arrived")
    rows = rows.withColumns({"f": I.fields(F.col("cleaned"), kinds), "missing": F.coalesce(F.col("cleaned") == "", F.lit(True))}).drop("cleaned")
    rows = rows.join(known, "named", "left").drop("named")
    f = F.col("f")
    has_zone, has_region = I.field(f, "zone") != "", I.field(f, "region") != ""
    tz = F.when(has_zone, I.offset(I.field(f, "zone"))).when(has_region, I.field(f, "region")).otherwise(F.col("zone_name"))
    (year, month, day), (hour, minute, seconds) = I.civil(f), I.clock(f)
    rows = rows.withColumns({"tz": tz, "local": ~has_zone & ~has_region, "numeric": F.coalesce(f[0] == "numeric", F.lit(False)), "y": year, "m": month, "d": day, "h": hour, "mi": minute, "s": seconds})
    # without a zone the date is judged in UTC: whether it is possible doesn't depend on the zone
    rows = rows.withColumn("judged", F.coalesce("tz", F.when(F.col("local"), F.lit("UTC"))))
    read = lambda month, day: I.instant_us(*map(F.col, ("y", month, day, "h", "mi", "s", "judged")))
    rows = rows.withColumns({"dmy": read("m", "d"), "mdy": F.when(F.col("numeric"), read("d", "m")), "epoch": F.when(f[0] == "epoch", I.epoch_us(f)), "kind": f[0]}).drop("f")
    days = lambda c: (F.col("arrived") - F.col(c)) / 86_400_000_000
    like = lambda c: F.when(F.col(c).isNull(), 0.0).when(F.col("arrived").isNull() | days(c).between(*PLAUSIBLE_DAYS), 1.0).otherwise(IMPLAUSIBLE)
    return rows.withColumns({"like_dmy": like("dmy"), "like_mdy": like("mdy")})


def normalize_instants(df: DataFrame, zones: DataFrame, text: str = "published_at", source: str = "feed_host", arrival: str | None = None, key: str = "id") -> DataFrame:
    """One row per row of ``df``: (key, utc_us, interpretation, posterior, status).

    ``zones`` has (``source``, zone_name, numeric_order), one row per source; rows with unknown zones or
    orders are kept as missing. ``status`` is

    * ``own``: already ``YYYY-MM-DDTHH:MM:SS.sssZ`` and possible;
    * ``resolved``: the text denotes one instant by itself, by its zone or by the declared order;
    * ``inferred``: an all-number date of undeclared order that the mixture of its source decides;
    * ``ambiguous``: the same, undecided (posterior under 0.95): no instant is given;
    * ``no_zone``: a possible local time whose source has no known zone;
    * ``invalid``: no date, or an impossible one. Null, empty and blank texts are ``missing``.

    Null sources share one mixture. Repeated rows each count and come out each. An empty input gives an
    empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    known = zones.select(F.col(source).alias("named"), "zone_name", F.lower("numeric_order").alias("declared")).filter(F.col("named").isNotNull()).dropDuplicates(["named"])
    arrived = F.unix_micros(F.col(arrival).cast("timestamp")) if arrival else F.lit(None).cast("bigint")
    given = df.select(F.col(key).alias("key"), F.col(source).alias("named"), F.col(text).alias("text"), arrived.alias("arrived"))
    # the mixtures need all-number dates only: the others aren't parsed for them
    votes = _readings(given.filter(F.col("text").rlike(ALL_NUMBER)), known, ("numeric",)).filter(F.col("declared").isNull())
    rows = _readings(given, known)

    undecided = F.col("numeric") & F.col("declared").isNull() & F.col("dmy").isNotNull() & F.col("mdy").isNotNull() & (F.col("dmy") != F.col("mdy"))
    mixed = mixtures(votes.select("source", "like_dmy", "like_mdy")).withColumnRenamed("source", "at")
    at = F.when(undecided, F.col("source")).otherwise(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("string")))
    rows = rows.withColumns({"undecided": undecided, "at": at}).join(mixed, "at", "left")

    p = F.col("p_dmy") * F.col("like_dmy") / (F.col("p_dmy") * F.col("like_dmy") + (1 - F.col("p_dmy")) * F.col("like_mdy"))
    p = F.when(~F.col("numeric"), 1.0).when(F.col("declared") == "dmy", 1.0).when(F.col("declared") == "mdy", 0.0).when(F.col("undecided"), p).when(F.col("dmy").isNotNull(), 1.0).otherwise(0.0)
    rows = rows.withColumn("p", p)
    chosen = F.when(F.col("epoch").isNotNull(), F.col("epoch")).when(F.col("p") >= 0.5, F.col("dmy")).otherwise(F.col("mdy"))
    rows = rows.withColumns({"chosen": chosen, "posterior": F.greatest("p", 1 - F.col("p"))})
    status = (
        F.when(F.col("missing"), "missing")
        .when(F.col("chosen").isNull(), "invalid")
        .when(F.col("own"), "own")
        .when(F.col("epoch").isNull() & F.col("tz").isNull(), "no_zone")
        .when(F.col("numeric") & F.col("declared").isNull() & (F.col("posterior") < RESOLVED), "ambiguous")
        .when(F.col("numeric") & F.col("declared").isNull(), "inferred")
        .otherwise("resolved")
    )
    settled = F.col("status").isin("own", "resolved", "inferred")
    how = F.when(F.col("numeric"), F.when(F.col("p") >= 0.5, "dmy").otherwise("mdy")).otherwise(F.col("kind"))
    return rows.withColumn("status", status).select(F.col("key").alias(key), F.when(settled, F.col("chosen")).alias("utc_us"), F.when(F.col("chosen").isNotNull(), how).alias("interpretation"), F.when(F.col("chosen").isNotNull(), F.col("posterior")).alias("posterior"), "status")
