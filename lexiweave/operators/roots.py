"""A word of another language for a sense: a ladder of evidence, all anchors and languages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions import fixed
from lexiweave.operators.vectors import cosine, nearest
from lexiweave.skew import hot_keys, salted_join

#: What speaks for a candidate, and when shared synsets overrule a link; fixed values.
LEMMA_BONUS, BONUS_PLACES, SWAP_MARGIN, WINNER_SYNSETS, POOL_SYNSETS = 0.02, 5, 0.01, 1, 2
RUNGS = ("corroborated", "primary", "ili_override", "ili", "llm", "fallback", "none")
_LAST = "\U0010ffff"


def likeness(a: Column, b: Column) -> Column:
    """Cosine of 0 at least, 0 where a vector is missing."""
    return F.round(F.greatest(F.lit(0.0), F.coalesce(cosine(a, b), F.lit(0.0))), 6)


def shown(links: DataFrame, anchors: DataFrame, senses: DataFrame) -> DataFrame:
    """The links (anchor_id, lexeme_id, ...) with the sense by which each lexeme is shown: (sense_id, language, sense_index, lemma, sim, effective).

    That is the sense most like the anchor; among the first BONUS_PLACES of a
    lexeme, one whose definition has all of the anchor's word without a hedge
    gains LEMMA_BONUS.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    j = links.join(anchors.select("anchor_id", F.col("vector").alias("_v"), F.col("lemma").alias("_word")), "anchor_id").join(senses, "lexeme_id")
    j = j.withColumn("sim", likeness(F.col("_v"), F.col("vector"))).withColumn("_own", tokens(F.col("_word"))).withColumn("_def", tokens(F.col("definition"))).drop("_v", "vector", "definition", "_word")
    names = [c for c in j.columns if c not in ("anchor_id", "lexeme_id")]
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("_neg"), "sense_id", *[c for c in names if c != "sense_id"]))), 1, BONUS_PLACES)  # the senses of one word
    told = lambda s: (F.size(s["_own"]) > 0) & (F.size(F.array_except(s["_own"], s["_def"])) == 0) & ~F.arrays_overlap(s["_def"], F.array(*map(F.lit, fixed.HEDGES)))
    scored = F.transform(first, lambda s: F.struct(F.round(-(s["sim"] + F.when(told(s), LEMMA_BONUS).otherwise(0.0)), 6).alias("_order"), s["sense_id"].alias("_id"), s.alias("s")))
    best = j.groupBy("anchor_id", "lexeme_id").agg(F.array_min(F.transform(scored, lambda x: F.struct(x["_order"], x["_id"]))).alias("b"), scored.alias("all"))
    one = F.filter("all", lambda x: x["_id"] == F.col("b._id"))[0]["s"]
    return best.select("anchor_id", "lexeme_id", (-F.col("b._order")).alias("effective"), one.alias("s")).select("anchor_id", "lexeme_id", "effective", *[F.col("s")[c].alias(c) for c in names if not c.startswith("_")])


def select_roots(anchors: DataFrame, anchor_ilis: DataFrame, links: DataFrame, senses: DataFrame, sense_ilis: DataFrame, goals: DataFrame, proposed: DataFrame | None = None, floors: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(anchor_id, language, rung, sense_id, sim): one row for each anchor and language of ``goals`` (language, number).

    ``anchors`` has anchor_id, lemma, vector; ``links`` has anchor_id, lexeme_id
    and original, whether it is the stored target or one that is spelt alike;
    ``proposed`` has such links by an external proposer, without original.
    ``senses`` has the visible senses as sense_id, lexeme_id, language,
    sense_index, lemma, definition, vector; ``sense_ilis`` (sense_id, ili) and
    ``anchor_ilis`` (anchor_id, ili) tell their synsets.

    A link that shares synsets goes before one that does not; a link that
    shares at most WINNER_SYNSETS may be overruled by a sense that shares more,
    POOL_SYNSETS at least, above the language's floor. Without a link a shared
    synset decides, then a proposed link, then the nearest sense above the
    fallback's floor. Where nothing is found the rung is "none". ``floors`` has
    those of rescue and fallback by language.
    """
    spark = anchors.sparkSession
    floors = floors or {"rescue": fixed.RESCUE_FLOORS, "fallback": fixed.FALLBACK_FLOORS}
    floor_rows = [(g, floors["rescue"].get(g), floors["fallback"].get(g)) for g in sorted({*floors["rescue"], *floors["fallback"]})]
    floor = F.broadcast(spark.createDataFrame(floor_rows, "language string, rescue double, fallback double"))
    ilis = sense_ilis.filter("ili IS NOT NULL").join(senses.select("sense_id", "lexeme_id"), "sense_id")
    mine = anchor_ilis.filter("ili IS NOT NULL").select("anchor_id", "ili").distinct()
    hot = hot_keys(ilis, "ili", ilis.count())

    # links, by synsets that lexeme and anchor share
    common = salted_join(ilis.select("lexeme_id", "ili").distinct(), mine, "ili", hot, "lexeme_id").groupBy("anchor_id", "lexeme_id").agg(F.countDistinct("ili").alias("n_shared"))
    c = shown(links.groupBy("anchor_id", "lexeme_id").agg(F.max("original").alias("original")), anchors, senses).join(common, ["anchor_id", "lexeme_id"], "left").na.fill(0, ["n_shared"]).join(floor.drop("fallback"), "language", "left")
    counted = F.when(F.col("sim") >= F.coalesce("rescue", F.lit(0.0)), F.col("n_shared")).otherwise(0)
    rank = F.round(F.col("effective") + F.when(F.col("original"), SWAP_MARGIN).otherwise(0.0), 6)
    order = F.struct((F.col("n_shared") == 0).alias("thin"), (-counted).alias("n"), (-rank).alias("r"), F.coalesce("sense_index", F.lit(2**31 - 1)).alias("i"), F.concat("lemma", F.lit(_LAST)).alias("l"), F.col("sense_id").alias("sense_id"), F.col("sim").alias("sim"))
    linked = c.groupBy("anchor_id", "language").agg(F.min(order).alias("w")).select("anchor_id", "language", F.when(F.col("w.thin"), "primary").otherwise("corroborated").alias("l_rung"), (-F.col("w.n")).alias("l_n"), F.col("w.sense_id").alias("l_sense"), F.col("w.sim").alias("l_sim"))

    # senses that share synsets, with or without a link
    pool = salted_join(ilis.select("sense_id", "ili").distinct(), mine, "ili", hot, "sense_id").groupBy("anchor_id", "sense_id").agg(F.countDistinct("ili").alias("n_shared"))
    pool = pool.join(senses.filter("vector IS NOT NULL").select("sense_id", "language", "vector"), "sense_id").join(anchors.select("anchor_id", F.col("vector").alias("_v")), "anchor_id").withColumn("sim", likeness(F.col("_v"), F.col("vector")))
    pool = pool.join(floor.drop("fallback"), "language", "left")
    counted = F.when(F.col("sim") >= F.coalesce("rescue", F.lit(0.0)), F.col("n_shared")).otherwise(0)
    pool = pool.groupBy("anchor_id", "language").agg(F.min(F.struct((-counted).alias("n"), (-F.col("sim")).alias("s"), "sense_id")).alias("p")).select("anchor_id", "language", (-F.col("p.n")).alias("p_n"), (-F.col("p.s")).alias("p_sim"), F.col("p.sense_id").alias("p_sense"))

    has = mine.select("anchor_id").distinct().withColumn("has_ilis", F.lit(True))
    j = anchors.select("anchor_id").join(has, "anchor_id", "left").withColumn("_g", F.lit(0)).join(F.broadcast(goals.select("language", "number").withColumn("_g", F.lit(0))), "_g").drop("_g")  # a row for each of the few languages
    j = j.join(linked, ["anchor_id", "language"], "left").join(pool, ["anchor_id", "language"], "left").join(floor, "language", "left")
    strong = F.col("l_sense").isNotNull() & (F.col("has_ilis").isNull() | (F.col("l_n") > WINNER_SYNSETS))
    overruled = F.col("l_sense").isNotNull() & ~strong & F.col("p_sense").isNotNull() & (F.col("p_n") >= POOL_SYNSETS) & (F.col("p_n") > F.col("l_n")) & (F.col("p_sim") >= F.coalesce("rescue", F.lit(0.0)))
    pick = lambda rung, sense, sim: F.struct(rung.alias("rung"), F.col(sense).alias("sense_id"), F.col(sim).alias("sim"))
    root = F.when(overruled, pick(F.lit("ili_override"), "p_sense", "p_sim")).when(F.col("l_sense").isNotNull(), pick(F.col("l_rung"), "l_sense", "l_sim")).when(F.col("p_sense").isNotNull(), pick(F.lit("ili"), "p_sense", "p_sim"))
    j = j.withColumn("root", root)
    if proposed is not None:
        told = shown(proposed.select("anchor_id", "lexeme_id").distinct(), anchors, senses).groupBy("anchor_id", "language").agg(F.min(F.struct((-F.col("effective")).alias("e"), F.col("lexeme_id"), F.col("sense_id").alias("x_sense"), F.col("sim").alias("x_sim"))).alias("x"))
        j = j.join(told.select("anchor_id", "language", "x.x_sense", "x.x_sim"), ["anchor_id", "language"], "left").withColumn("root", F.coalesce("root", F.when(F.col("x_sense").isNotNull(), pick(F.lit("llm"), "x_sense", "x_sim"))))

    # what is left looks for its nearest sense; a query is an anchor and a language
    pair = F.xxhash64("anchor_id", "language")
    open_ = j.filter("root IS NULL AND fallback IS NOT NULL").select("anchor_id", "language", "fallback", pair.alias("id")).join(anchors.select("anchor_id", "vector"), "anchor_id")
    own = senses.select(F.col("sense_id").alias("id"), "language", "vector")
    near = nearest(open_.select("id", "language", "vector"), own, 1, "language").withColumnRenamed("query_id", "id").join(open_.select("id", "anchor_id", "language", "fallback"), "id")
    near = near.filter("sim >= fallback").select("anchor_id", "language", F.col("row_id").alias("f_sense"), F.col("sim").alias("f_sim"))
    j = j.join(near, ["anchor_id", "language"], "left").withColumn("root", F.coalesce("root", F.when(F.col("f_sense").isNotNull(), pick(F.lit("fallback"), "f_sense", "f_sim"))))
    return j.select("anchor_id", "language", F.coalesce("root.rung", F.lit("none")).alias("rung"), "root.sense_id", "root.sim")
