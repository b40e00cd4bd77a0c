"""Feasibility of substances as sensing targets: compounds in four graded steps, mixtures by weight, classes as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.functions import catalogue, physics
from vapora.plans import views

GRADES = ("green", "yellow", "red")
#: Substances that an array of so many sensors tells apart; others get the default.
CAPACITY = {3: 6, 4: 12, 5: 20, 6: 40, 12: 200, 24: 10000}
DEFAULT_SENSORS, DEFAULT_CAPACITY = 6, 40
#: Shares of a mixture's weight that turn it red and yellow.
RED_SHARE, YELLOW_SHARE = 0.5, 0.4
SCORES = {"strong": 1.0, "moderate": 0.6, "weak": 0.3, "none": 0.0}


def vapor_pressure(compounds: DataFrame) -> DataFrame:
    """compounds with vp (Pa) and vp_source: measured value, Antoine, a gas's atmosphere, boiling point with Trouton's enthalpy, or unknown."""
    boil = F.col("boiling_point.value") + 273.15
    c = compounds.withColumn("vp", F.coalesce(
        F.col("vapor_pressure.value"), physics.antoine(F.col("antoine.a"), F.col("antoine.b"), F.col("antoine.c"), 25.0), F.when(F.col("gas"), F.lit(physics.ATM)),
        physics.clausius_clapeyron(physics.AMBIENT_K, boil, physics.trouton(boil)), F.lit(0.0),
    ))
    source = F.when(F.col("vapor_pressure.value").isNotNull(), F.col("vapor_pressure.source")).when(F.col("antoine").isNotNull() | F.col("gas"), "measured")
    return c.withColumn("vp_source", source.when(F.col("boiling_point.value").isNotNull(), "estimated").otherwise("unknown"))


def constituent_chain(compounds: DataFrame) -> DataFrame:
    """compounds with the grade of each step (identity, volatility, signal, reactivity), the worst as verdict, signal, speed, score and confidence."""
    c = vapor_pressure(compounds).withColumn("known", F.col("vp_source") != "unknown")
    c = c.withColumn("volatility", physics.volatility_label(F.when(F.col("known"), F.col("vp"))))
    c = c.withColumn("ppm", F.when(~F.col("gas") & F.col("known") & (F.col("vp") > 0), F.col("vp") / physics.ATM * 1e6))
    c = c.withColumn("band", F.when(F.col("gas"), "strong").otherwise(F.coalesce(F.when(F.col("ppm").isNotNull(), physics.headspace_band(F.col("ppm"))), F.lit("unknown"))))
    c = c.withColumns({
        "g_volatility": F.expr("CASE WHEN gas THEN 'green' WHEN NOT known THEN 'yellow' WHEN volatility IN ('very high', 'high', 'moderate') THEN 'green' WHEN volatility = 'low' THEN 'yellow' ELSE 'red' END"),
        "g_signal": F.expr("CASE WHEN band IN ('strong', 'moderate') THEN 'green' WHEN band IN ('weak', 'unknown') THEN 'yellow' ELSE 'red' END"),
        "g_reactivity": F.expr("CASE WHEN coalesce(non_redox, false) THEN 'red' WHEN coalesce(redox_active, false) THEN 'green' ELSE 'yellow' END"),
        "signal_strength": F.expr("CASE WHEN band IN ('strong', 'moderate', 'weak') THEN band WHEN band = 'marginal' THEN 'weak' ELSE 'none' END"),
        "response_speed": F.expr("CASE WHEN gas OR (known AND vp >= 1000D) THEN 'fast' WHEN known AND vp >= 100D THEN 'medium' WHEN known AND vp >= 1D THEN 'slow' ELSE 'unknown' END"),
    })
    ref = compounds.sparkSession.createDataFrame(catalogue.compound_rows()[:1], catalogue.COMPOUND_SCHEMA)
    reference = vapor_pressure(ref).select(physics.flux_share(F.col("vp"), F.col("molecular_weight.value")).alias("reference"), F.col("vp_source").alias("reference_source"))
    c = c.join(F.broadcast(reference))
    c = c.withColumn("ratio", F.when(F.col("known") & (F.col("vp") > 0), physics.flux_share(F.col("vp"), F.col("molecular_weight.value")) / F.col("reference")).otherwise(0.0))
    c = c.withColumn("ratio_source", F.expr("CASE WHEN NOT known OR vp <= 0D THEN vp_source WHEN vp_source = 'measured' AND reference_source = 'measured' THEN 'measured' ELSE 'estimated' END"))
    sources = "array(molecular_weight.source, boiling_point.source, vp_source, CASE WHEN gas THEN 'measured' WHEN ppm IS NULL THEN 'unknown' ELSE vp_source END, ratio_source, CASE WHEN size(groups) > 0 THEN 'measured' ELSE 'estimated' END)"
    c = c.withColumn("confidence", F.expr(confidence(sources)))
    c = c.withColumn("verdict", F.expr("CASE WHEN 'red' IN (g_volatility, g_signal, g_reactivity) THEN 'red' WHEN 'yellow' IN (g_volatility, g_signal, g_reactivity) THEN 'yellow' ELSE 'green' END"))
    score = F.create_map(*(F.lit(x) for k, v in SCORES.items() for x in (k, v)))
    return c.withColumn("signal_score", F.element_at(score, F.col("signal_strength"))).drop("reference", "reference_source", "known")


def confidence(sources: str) -> str:
    return f"CASE WHEN array_contains({sources}, 'unknown') THEN 'low' WHEN array_contains({sources}, 'estimated') THEN 'medium' ELSE 'high' END"


def told_pa(pa: Column) -> Column:
    """A pressure in words: Pa below a kilopascal, two decimals of kPa below a hundred."""
    return F.when(pa.isNull(), "unknown").when(pa >= 100_000, F.format_string("%.0f kPa", pa / 1000)).when(pa >= 1000, F.format_string("%.2f kPa", pa / 1000)).otherwise(F.format_string("%.0f Pa", pa))


def told_ratio(ratio: Column) -> Column:
    """A signal in words, as a multiple of ethanol's or a share of it."""
    large = F.when(ratio >= 10, F.format_string("%.1f× ethanol", ratio)).when(ratio >= 1, F.format_string("%.2f× ethanol", ratio))
    return large.when(ratio >= 0.1, F.format_string("%.0f%% of ethanol", ratio * 100)).otherwise(F.format_string("%.1f%% of ethanol", ratio * 100))


def told_ppm(ppm: Column) -> Column:
    """A concentration in words: thousands from ten thousand on, whole numbers from a hundred on."""
    return F.when(ppm.isNull(), "unknown").when(ppm >= 10_000, F.format_string("%.0fk", ppm / 1000)).when(ppm >= 100, F.bround(ppm).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", ppm))


def with_reasons(chain: DataFrame) -> DataFrame:
    """chain with a sentence for each graded step."""
    chain = chain.withColumns({"_pa": told_pa(F.col("vp")), "_ppm": told_ppm(F.col("ppm"))})
    return chain.withColumns({
        "r_volatility": F.expr("CASE WHEN gas THEN name || ' is a gas at room temperature.' WHEN vp_source = 'unknown' THEN 'Vapor pressure unknown.' ELSE format_string('%s has %s volatility (%s at 25 C).', name, volatility, _pa) END"),
        "r_signal": F.expr("CASE WHEN gas THEN name || ' is available as full vapor.' WHEN ppm IS NULL THEN 'Headspace concentration unknown.' ELSE format_string('Saturated headspace is about %s ppm.', _ppm) END"),
        "r_reactivity": F.expr("CASE WHEN id = 'water' THEN 'Humidity moves the baseline: expect a baseline shift, not a response.' WHEN g_reactivity = 'red' THEN name || ' is not redox-active at operating temperature.' WHEN g_reactivity = 'green' THEN 'Contains ' || array_join(groups, ', ') || ', oxidised at the sensor surface.' ELSE name || ' is not a reducing gas; any response is indirect.' END"),
    }).drop("_pa", "_ppm")


def guidance(verdicts: DataFrame) -> DataFrame:
    """verdicts with dilution advice and exposure seconds for their signal and speed."""
    return verdicts.withColumns({
        "exposure_s": F.expr("CASE WHEN signal_strength = 'strong' AND response_speed = 'fast' THEN '10-30' WHEN signal_strength = 'strong' THEN '20-40' WHEN signal_strength = 'moderate' THEN '30-60' WHEN signal_strength = 'weak' THEN '60-120' END"),
        "dilution": F.expr("CASE WHEN signal_strength = 'strong' AND response_speed = 'fast' THEN '1:10' WHEN signal_strength = 'strong' THEN '1:5' WHEN signal_strength = 'moderate' THEN '1:3' WHEN signal_strength = 'weak' THEN 'none' END"),
    })


def composite_verdict(composites: DataFrame, compounds: DataFrame) -> DataFrame:
    """Mixtures graded from their constituents found among compounds (catalogue first where ids repeat); a mixture without any is green with high confidence."""
    parts = composites.select("id", "name", F.posexplode_outer("constituents").alias("pos", "part")).select("id", "name", "pos", F.col("part.chemical_id").alias("chemical_id"), F.coalesce("part.weight", F.lit(0.0)).alias("weight"))
    first = Window.partitionBy("id").orderBy(F.col("provisional").asc(), "ord")
    chain = constituent_chain(compounds.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))
    graded = chain.select(F.col("id").alias("chemical_id"), F.col("verdict").alias("v"), F.col("signal_strength").alias("s"), F.col("response_speed").alias("sp"), "signal_score", F.col("confidence").alias("cf"))
    rows = parts.join(graded, "chemical_id", "left").withColumn("weight", F.when(F.col("v").isNotNull(), F.col("weight")))
    g = rows.groupBy("id", "name").agg(
        F.sum("weight").alias("all"), F.sum(F.when(F.col("v") == "red", F.col("weight"))).alias("red"), F.sum(F.when(F.col("v") != "green", F.col("weight"))).alias("dull"),
        F.count("v").alias("n_resolved"), F.min_by(F.struct("s", "sp", "chemical_id"), F.when(F.col("v").isNotNull(), F.struct((-F.col("weight") * F.col("signal_score")).alias("c"), "pos"))).alias("top"),
        F.coalesce(F.bool_or(F.col("cf") == "low"), F.lit(False)).alias("low"), F.coalesce(F.bool_or(F.col("cf") == "medium"), F.lit(False)).alias("medium"),
    )
    # As weights are shares of the resolved constituents, comparisons are made after dividing.
    share = lambda c: F.coalesce(F.col(c) / F.when(F.col("all") > 0, F.col("all")), F.lit(0.0))
    return g.select(
        "id", "name", "n_resolved", share("red").alias("red_share"), share("dull").alias("non_green_share"),
        F.when(share("red") > RED_SHARE, "red").when(share("dull") > YELLOW_SHARE, "yellow").otherwise("green").alias("verdict"),
        F.coalesce("top.s", F.lit("none")).alias("signal_strength"), F.coalesce("top.sp", F.lit("unknown")).alias("response_speed"), F.col("top.chemical_id").alias("dominant"),
        F.when(F.col("low"), "low").when(F.col("medium"), "medium").otherwise("high").alias("confidence"),
    )


def class_verdict(classes: DataFrame, *keep: str) -> DataFrame:
    """Classes, with the columns to keep, always grade yellow with low confidence."""
    return classes.select(*keep, F.concat(F.lit("class:"), "class").alias("id"), F.col("label").alias("name"), F.lit("yellow").alias("verdict"), F.lit("low").alias("confidence"), F.lit("moderate").alias("signal_strength"), F.lit("medium").alias("response_speed"))


def resolve(spark: SparkSession, entity: str, kind: str, extra: DataFrame | None = None) -> DataFrame:
    """Verdict rows of one entity; a class id may carry its prefix. Unknown entities give no row."""
    known = catalogue.compounds(spark)
    known = known.unionByName(extra) if extra is not None else known
    if kind == "chemical":
        return constituent_chain(known.where(F.col("id") == entity)).orderBy("provisional").limit(1)
    if kind == "composite":
        return composite_verdict(catalogue.composites(spark).where(F.col("id") == entity), known)
    return class_verdict(catalogue.classes(spark).where(F.col("class") == entity.removeprefix("class:")))


def verdicts_of(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (entity, and any columns) with the chain of the compound of that id among known ones, the catalogue's before a user's; NULLs for unknown ids."""
    first = Window.partitionBy("id").orderBy(F.col("provisional").asc(), "ord")
    chain = constituent_chain(known.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))
    return asked.join(chain, asked["entity"] == chain["id"], "left")


def cross_check(entities: DataFrame, library: DataFrame, sensors: int = DEFAULT_SENSORS) -> DataFrame:
    """entities (id, name, synonyms) with capacity and the library's labels (label) that may be confused with them."""
    lib = library.select("label", F.lower("label").alias("_l"))
    hit = (F.col("_l") == F.lower("name")) | F.exists("synonyms", lambda s: F.lower(s) == F.col("_l")) | F.lower("name").contains(F.col("_l")) | F.col("_l").contains(F.lower("name"))
    # A theta join: the dictionary of entities is small and fixed, so the library is read once.
    found = lib.join(F.broadcast(entities.select("id", "name", "synonyms")), hit).groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("confusable"))
    out = entities.select("id", "name").join(found, "id", "left")
    return out.select("id", "name", F.lit(CAPACITY.get(sensors, DEFAULT_CAPACITY)).alias("max_distinguishable"), F.coalesce("confusable", F.array().cast("array<string>")).alias("confusable"))


def percepts_of(compounds: DataFrame) -> DataFrame:
    """A row per compound and percept that it has, by group or by a keyword in its name or odour: ord, group_hit."""
    p = F.broadcast(catalogue.percepts(compounds.sparkSession).select(F.col("ord").alias("p_ord"), "percept", F.col("label").alias("p_label"), F.col("groups").alias("p_groups"), "keywords"))
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("odor", F.lit(""))))
    c = compounds.withColumn("_text", text)
    group = F.arrays_overlap("groups", "p_groups")
    return c.join(p, group | F.exists("keywords", lambda k: F.col("_text").contains(k))).select("id", "name", F.col("p_ord").alias("ord"), "percept", F.col("p_label").alias("label"), F.coalesce(group, F.lit(False)).alias("group_hit"))


def top_percepts(compounds: DataFrame, most: int = 3) -> DataFrame:
    """Per compound its first percepts and the dominant one: the first by a group, else the first."""
    p = percepts_of(compounds).groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "percept"))).alias("all"), F.min_by("percept", F.struct((~F.col("group_hit")).alias("g"), "ord")).alias("dominant"))
    return p.select("id", "name", F.size("all").alias("n_percepts"), F.expr(f"transform(slice(all, 1, {most}), x -> x.percept)").alias("top"), "dominant", F.col("dominant").isin(*catalogue.LOW_VOLATILITY).alias("low_volatility"))


#: What a chemiresistive array can tell and what it can't: id | domain | capability.
BOUNDARIES = """
functional-groups|Identity|can
molecular-size|Identity|can
vapor-pressure|Identity|can
redox|Reactivity|can
structure|Identity|cannot
concentration|Concentration|cannot
non-redox|Reactivity|cannot
trace|Sensitivity|cannot
mixture|Composition|cannot
"""


def boundaries(spark: SparkSession) -> DataFrame:
    """id, domain, capability."""
    rows = [tuple(line.split("|")) for line in BOUNDARIES.strip().splitlines()]
    return spark.createDataFrame([(i, d, c == "can") for i, d, c in rows], "id string, domain string, capability boolean")


def relevant_boundaries(verdicts: DataFrame) -> DataFrame:
    """verdicts (kind, signal_strength; g_reactivity and ppm of compounds) with the ids of the boundaries that they touch."""
    have = set(verdicts.columns)
    inert = "g_reactivity = 'red'" if "g_reactivity" in have else "false"
    trace = "signal_strength = 'none' AND ppm IS NOT NULL" if "ppm" in have else "false"
    return verdicts.withColumn("boundaries", F.expr(f"array_compact(array(CASE WHEN {inert} THEN 'non-redox' END, CASE WHEN {trace} THEN 'trace' END, CASE WHEN kind = 'composite' THEN 'mixture' END, CASE WHEN kind = 'class' THEN 'structure' END))"))


def perceptual_summary(verdicts: DataFrame, percepts: DataFrame) -> DataFrame:
    """verdicts (id, name, verdict, confidence) with a sentence on what they smell of and what the array makes of it."""
    p = percepts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "percept", F.lower("label").alias("label")))).alias("p"))
    v = verdicts.join(p, "id", "left").withColumn("hat", F.expr("coalesce(array_join(transform(slice(p, 1, 3), x -> x.label), '; '), 'unclassified chemistry')"))
    slow = "element_at(p, 1).percept IN ({})".format(", ".join(f"'{x}'" for x in catalogue.LOW_VOLATILITY))
    told = f"CASE WHEN verdict = 'red' THEN 'no usable signal' WHEN confidence = 'low' THEN 'a response, its strength a guess' WHEN size(p) > 0 AND {slow} THEN 'a weak, slow response' ELSE 'a clear reducing response' END"
    return v.withColumn("summary", F.expr(f"name || ' reads as ' || hat || ': ' || {told} || '.'")).drop("p", "hat")


def _q_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("x", F.expr("pow(10D, o_orderkey % 9 - 4) * o_totalprice / 1000D"))
    return o.select("o_orderkey", physics.volatility_label(F.col("x")).alias("volatility"), physics.headspace_band(F.col("x")).alias("headspace"), physics.signal_band(F.col("x")).alias("signal"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' substances under their own ids."""
    return views.substances(spark, sf_dir).withColumn("id", F.col("p_partkey"))


def _q_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals over nine powers of ten as pressures, shares and concentrations in words."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("x", F.expr("CASE WHEN o_orderkey % 50 > 0 THEN pow(10D, o_orderkey % 9 - 5) * (o_totalprice + 0.123D) / 70D END"))
    return o.select("o_orderkey", told_pa(F.col("x")).alias("pressure"), told_ratio(F.coalesce("x", F.lit(0.0)) / 100).alias("ratio"), told_ppm(F.col("x")).alias("concentration"))


def _q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _parts(spark, sf_dir)
    v = relevant_boundaries(constituent_chain(c).withColumn("kind", F.lit("chemical")))
    return perceptual_summary(v, percepts_of(c)).selectExpr("id AS p_partkey", "summary", "array_join(boundaries, ',') AS boundaries")


def _q_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = constituent_chain(views.substances(spark, sf_dir))
    return out.selectExpr("p_partkey", "id", "verdict", "g_volatility", "g_signal", "g_reactivity", "signal_strength", "response_speed", "confidence", "vp_source", f"{A.snap('vp', 3)} AS vp", f"{A.snap('ratio', 6)} AS ratio")


def _q_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mixtures: a constituent for each line, its part's substance by quantity; every ninth part's is unknown."""
    lines = views.table(spark, sf_dir, "lineitem").join(views.substances(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "id"), "l_partkey")
    lines = lines.withColumn("id", F.when(F.col("l_partkey") % 9 == 0, "unheard-of").otherwise(F.col("id")))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("id").alias("chemical_id"), F.col("l_quantity").alias("weight"))))
    mixes = lines.groupBy(F.col("l_orderkey").alias("id")).agg(parts.alias("constituents")).withColumn("name", F.concat(F.lit("order "), "id"))
    out = composite_verdict(mixes, catalogue.compounds(spark))
    return out.selectExpr("id", "name", "verdict", "signal_strength", "response_speed", "dominant", "confidence", "n_resolved", f"{A.snap('red_share', 6)} AS red_share", f"{A.snap('non_green_share', 6)} AS non_green_share")


def _q_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that each part's substance belongs to, as targets of their own."""
    groups = views.substances(spark, sf_dir).select("p_partkey", F.explode("groups").alias("class"))
    return class_verdict(groups.join(F.broadcast(catalogue.classes(spark).select("class", "label")), "class"), "p_partkey")


def _q_percepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_percepts(_parts(spark, sf_dir)).selectExpr("id AS p_partkey", "n_percepts", "array_join(top, ',') AS top", "dominant", "low_volatility")


def _q_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("element_at(array('', 'Ripe ', 'Gas ', ''), cast(p_partkey % 4 + 1 AS int)) || element_at(array('ethanol', 'Acetone', 'lpg', 'butane', 'H2O', 'widget', 'Phenol', 'toluol'), cast(p_size % 8 + 1 AS int)) AS label").distinct()
    return cross_check(catalogue.compounds(spark), parts, 6).selectExpr("id", "max_distinguishable", "array_join(confusable, ',') AS confusable")


def _q_physics(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = views.substances(spark, sf_dir)
        mw, boil = F.col("molecular_weight.value"), F.col("boiling_point.value") + 273.15
        if kind == "antoine":
            out = c.where("antoine IS NOT NULL").withColumn("pa", physics.antoine(F.col("antoine.a"), F.col("antoine.b"), F.col("antoine.c"), 25.0)).withColumn("flux", physics.evaporation_flux(F.col("pa"), mw / 1000))
            return out.selectExpr("p_partkey", "id", f"{A.snap('pa', 3)} AS pa", f"{A.snap('flux', 6)} AS flux")
        if kind == "clausius":
            return c.withColumn("pa", physics.clausius_clapeyron(physics.AMBIENT_K, boil, physics.trouton(boil))).selectExpr("p_partkey", "id", f"{A.snap('log10(pa)', 6)} AS log10_pa")
        out = c.withColumn("d", physics.fuller(mw, physics.diffusion_volume(mw))).withColumn("c", physics.concentration_at(F.lit(1e-6), F.col("d"), F.lit(0.1))).withColumn("i", physics.incident_flux(F.col("c"), mw / 1000))
        return out.selectExpr("p_partkey", "id", f"{A.snap('d * 1e6D', 6)} AS d_mm2", f"{A.snap('c', 6)} AS c", f"{A.snap('i', 5)} AS i")

    return query


QUERIES = {
    "constituent_chain": _q_chain, "composite_verdict": _q_composite, "class_verdict": _q_class, "percepts_for": _q_percepts, "cross_check": _q_cross,
    "bands": _q_bands, "value_formats": _q_told, "perceptual_summary": _q_summary, "antoine_vapor": _q_physics("antoine"), "clausius_clapeyron": _q_physics("clausius"), "fuller_diffusion": _q_physics("fuller"),
}


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _d(x: float | None) -> str:
    return "NULL::DOUBLE" if x is None else f"{x!r}::DOUBLE"


_COMPOUNDS = "cp(id, name, syn, mw, mw_s, bp, bp_s, vp0, vp0_s, aa, ab, ac, groups, gas, redox, inert, odor) AS (VALUES " + ", ".join(
    f"({_q(i)}, {_q(n)}, [{', '.join(map(_q, syn))}], {_d(mw[0])}, {_q(mw[1])}, {_d(bp[0])}, {_q(bp[1])}, {_d(vp[0])}, {_q(vp[1])}, {', '.join(map(_d, ant or (None,) * 3))}, [{', '.join(map(_q, g))}], {gas}, {redox}, {inert}, {_q(odor)})"
    for _, i, n, syn, mw, bp, vp, ant, g, gas, redox, inert, odor, *_ in catalogue.compound_rows()
) + ")"
_D = "0.00143::DOUBLE * pow(298.15::DOUBLE, 1.75::DOUBLE) / pow(pow(20.1::DOUBLE, 1 / 3::DOUBLE) + pow(1.1::DOUBLE * mw, 1 / 3::DOUBLE), 2) * sqrt(1 / 28.97::DOUBLE + 1 / mw) * 1e-4::DOUBLE"
_CHAIN = f"""{_COMPOUNDS},
v AS (SELECT *, CASE WHEN vp0 IS NOT NULL THEN vp0 WHEN aa IS NOT NULL THEN pow(10, aa - ab / (25 + ac)) * 133.322::DOUBLE WHEN gas THEN 101325::DOUBLE ELSE 101325::DOUBLE * exp(-(88 * (bp + 273.15::DOUBLE) / 8.314::DOUBLE) * (1 / 298.15::DOUBLE - 1 / (bp + 273.15::DOUBLE))) END AS vp,
  CASE WHEN vp0 IS NOT NULL THEN vp0_s WHEN aa IS NOT NULL OR gas THEN 'measured' ELSE 'estimated' END AS vs FROM cp),
w AS (SELECT *, vp / 101325 * 1e6 AS ppm, vp / (mw / 1000 * ({_D})) AS share FROM v),
s AS (SELECT *, CASE WHEN gas OR ppm >= 1000 THEN 'strong' WHEN ppm >= 100 THEN 'moderate' WHEN ppm >= 10 THEN 'weak' WHEN ppm >= 1 THEN 'marginal' ELSE 'none' END AS band, share / (SELECT share FROM w WHERE id = 'ethanol') AS ratio FROM w),
ch AS (SELECT *, CASE WHEN gas OR vp >= 100 THEN 'green' WHEN vp >= 1 THEN 'yellow' ELSE 'red' END AS g_volatility, CASE WHEN band IN ('strong', 'moderate') THEN 'green' WHEN band = 'weak' THEN 'yellow' ELSE 'red' END AS g_signal, CASE WHEN inert THEN 'red' WHEN redox THEN 'green' ELSE 'yellow' END AS g_reactivity,
  CASE WHEN band = 'marginal' THEN 'weak' ELSE band END AS sig, CASE WHEN gas OR vp >= 1000 THEN 'fast' WHEN vp >= 100 THEN 'medium' WHEN vp >= 1 THEN 'slow' ELSE 'unknown' END AS speed, CASE WHEN 'estimated' IN (mw_s, bp_s, vs) THEN 'medium' ELSE 'high' END AS conf FROM s),
cv AS (SELECT *, CASE WHEN 'red' IN (g_volatility, g_signal, g_reactivity) THEN 'red' WHEN 'yellow' IN (g_volatility, g_signal, g_reactivity) THEN 'yellow' ELSE 'green' END AS verdict FROM ch)"""
_PERCEPTS = "pc(ord, percept, groups, words) AS (VALUES " + ", ".join(f"({k}, {_q(i)}, [{', '.join(map(_q, g))}]::VARCHAR[], [{', '.join(map(_q, w))}])" for k, i, _, g, w in catalogue.percept_rows()) + ")"
_PERCEPTS_L = "pc(ord, percept, label, groups, words) AS (VALUES " + ", ".join(f"({k}, {_q(i)}, {_q(label)}, [{', '.join(map(_q, g))}]::VARCHAR[], [{', '.join(map(_q, w))}])" for k, i, label, g, w in catalogue.percept_rows()) + ")"
_s = A.snap
ORACLE_SQL = {
    "constituent_chain": f"WITH {_CHAIN}, {views.PARTS} SELECT p_partkey, id, verdict, g_volatility, g_signal, g_reactivity, sig AS signal_strength, speed AS response_speed, conf AS confidence, vs AS vp_source, {_s('vp', 3)} AS vp, {_s('ratio', 6)} AS ratio FROM cv JOIN pt USING (id)",
    "composite_verdict": f"""WITH {_CHAIN}, {views.PARTS}, mx AS (SELECT l_orderkey AS id, CASE WHEN l_partkey % 9 = 0 THEN 'unheard-of' ELSE pt.id END AS chem, l_quantity AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'unheard-of' ELSE pt.id END, l_quantity) AS pos FROM lineitem JOIN pt ON p_partkey = l_partkey),
j AS (SELECT mx.id, pos, chem, CASE WHEN verdict IS NOT NULL THEN w END AS w, verdict, sig, speed, conf, CASE sig WHEN 'strong' THEN 1 WHEN 'moderate' THEN 0.6 WHEN 'weak' THEN 0.3 ELSE 0 END::DOUBLE AS sc FROM mx LEFT JOIN cv ON mx.chem = cv.id),
g AS (SELECT id, count(verdict) AS n, sum(w) AS a, coalesce(sum(w) FILTER (verdict = 'red'), 0) AS r, coalesce(sum(w) FILTER (verdict <> 'green'), 0) AS d, arg_min({{'s': sig, 'p': speed, 'c': chem}}, (-w * sc, pos)) FILTER (verdict IS NOT NULL) AS t, coalesce(bool_or(conf = 'medium'), false) AS m FROM j GROUP BY id)
SELECT id, 'order ' || id AS name, CASE WHEN n > 0 AND r / a > 0.5 THEN 'red' WHEN n > 0 AND d / a > 0.4 THEN 'yellow' ELSE 'green' END AS verdict, coalesce(t.s, 'none') AS signal_strength, coalesce(t.p, 'unknown') AS response_speed, t.c AS dominant, CASE WHEN m THEN 'medium' ELSE 'high' END AS confidence, n AS n_resolved, {_s('coalesce(r / nullif(a, 0), 0)', 6)} AS red_share, {_s('coalesce(d / nullif(a, 0), 0)', 6)} AS non_green_share FROM g""",
    "class_verdict": f"WITH {_COMPOUNDS}, {views.PARTS}, cl(k, l) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(label)})" for _, k, label, _ in catalogue.class_rows()) + "), e AS (SELECT p_partkey, unnest(groups) AS k FROM pt JOIN cp USING (id)) SELECT p_partkey, 'class:' || k AS id, l AS name, 'yellow' AS verdict, 'low' AS confidence, 'moderate' AS signal_strength, 'medium' AS response_speed FROM e JOIN cl USING (k)",
    "percepts_for": f"""WITH {_COMPOUNDS}, {_PERCEPTS}, {views.PARTS}, j AS (SELECT p_partkey, pc.ord, percept, list_has_any(cp.groups, pc.groups) AS hit FROM pt JOIN cp USING (id) JOIN pc ON list_has_any(cp.groups, pc.groups) OR len(list_filter(words, lambda w: contains(lower(name || ' ' || odor), w))) > 0)
SELECT p_partkey, count(*)::INT AS n_percepts, array_to_string(list(percept ORDER BY ord)[:3], ',') AS top, arg_min(percept, (NOT hit, ord)) AS dominant, arg_min(percept, (NOT hit, ord)) IN ('spicy-balsamic', 'smoky-phenolic') AS low_volatility FROM j GROUP BY p_partkey""",
    "cross_check": f"""WITH {_COMPOUNDS}, lib AS (SELECT DISTINCT ['', 'Ripe ', 'Gas ', ''][p_partkey % 4 + 1] || ['ethanol', 'Acetone', 'lpg', 'butane', 'H2O', 'widget', 'Phenol', 'toluol'][p_size % 8 + 1] AS label FROM part)
SELECT id, 40 AS max_distinguishable, coalesce(string_agg(label, ',' ORDER BY label), '') AS confusable FROM cp LEFT JOIN lib ON lower(label) = lower(name) OR list_contains(list_transform(syn, lambda x: lower(x)), lower(label)) OR contains(lower(name), lower(label)) OR contains(lower(label), lower(name)) GROUP BY id""",
    "value_formats": """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 > 0 THEN pow(10::DOUBLE, o_orderkey % 9 - 5) * (o_totalprice + 0.123::DOUBLE) / 70::DOUBLE END AS x FROM orders), y AS (SELECT *, coalesce(x, 0) / 100 AS r FROM x)
SELECT o_orderkey, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 100000 THEN printf('%.0f kPa', x / 1000) WHEN x >= 1000 THEN printf('%.2f kPa', x / 1000) ELSE printf('%.0f Pa', x) END AS pressure,
  CASE WHEN r >= 10 THEN printf('%.1f× ethanol', r) WHEN r >= 1 THEN printf('%.2f× ethanol', r) WHEN r >= 0.1 THEN printf('%.0f%% of ethanol', r * 100) ELSE printf('%.1f%% of ethanol', r * 100) END AS ratio,
  CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 10000 THEN printf('%.0fk', x / 1000) WHEN x >= 100 THEN round_even(x, 0)::BIGINT::VARCHAR ELSE printf('%.1f', x) END AS concentration FROM y""",
    "bands": """WITH x AS (SELECT o_orderkey, pow(10, o_orderkey % 9 - 4) * o_totalprice / 1000::DOUBLE AS x FROM orders),
v(lo, hi, l) AS (VALUES (10000, 1e300, 'very high'), (1000, 10000, 'high'), (100, 1000, 'moderate'), (1, 100, 'low'), (0, 1, 'negligible')), h(lo, hi, l) AS (VALUES (1000, 1e300, 'strong'), (100, 1000, 'moderate'), (10, 100, 'weak'), (1, 10, 'marginal'), (0, 1, 'none')), s(lo, hi, l) AS (VALUES (1, 1e300, 'strong'), (0.1, 1, 'moderate'), (0.01, 0.1, 'weak'), (0.001, 0.01, 'marginal'), (0, 0.001, 'none'))
SELECT o_orderkey, v.l AS volatility, h.l AS headspace, s.l AS signal FROM x JOIN v ON x >= v.lo AND x < v.hi JOIN h ON x >= h.lo AND x < h.hi JOIN s ON x >= s.lo AND x < s.hi""",
    "perceptual_summary": f"""WITH {_CHAIN}, {_PERCEPTS_L}, {views.PARTS}, j AS (SELECT cv.id, pc.ord, pc.percept, lower(pc.label) AS label FROM cv JOIN pc ON list_has_any(cv.groups, pc.groups) OR len(list_filter(words, lambda w: contains(lower(name || ' ' || odor), w))) > 0),
p AS (SELECT id, array_to_string(list(label ORDER BY ord)[:3], '; ') AS hat, arg_min(percept, ord) AS first FROM j GROUP BY id)
SELECT p_partkey, name || ' reads as ' || coalesce(hat, 'unclassified chemistry') || ': ' || CASE WHEN verdict = 'red' THEN 'no usable signal' WHEN first IN ('spicy-balsamic', 'smoky-phenolic') THEN 'a weak, slow response' ELSE 'a clear reducing response' END || '.' AS summary,
  array_to_string(list_filter([CASE WHEN g_reactivity = 'red' THEN 'non-redox' END, CASE WHEN sig = 'none' AND NOT gas THEN 'trace' END], lambda x: x IS NOT NULL), ',') AS boundaries FROM pt JOIN cv USING (id) LEFT JOIN p ON cv.id = p.id""",
    "antoine_vapor": f"WITH {_COMPOUNDS}, {views.PARTS}, a AS (SELECT id, mw, pow(10, aa - ab / (25 + ac)) * 133.322::DOUBLE AS pa FROM cp WHERE aa IS NOT NULL) SELECT p_partkey, id, {_s('pa', 3)} AS pa, {_s('pa / sqrt(2 * pi() * mw / 1000 * 8.314::DOUBLE * 298.15::DOUBLE)', 6)} AS flux FROM a JOIN pt USING (id)",
    "clausius_clapeyron": f"WITH {_COMPOUNDS}, {views.PARTS}, a AS (SELECT id, 101325::DOUBLE * exp(-(88 * (bp + 273.15::DOUBLE) / 8.314::DOUBLE) * (1 / 298.15::DOUBLE - 1 / (bp + 273.15::DOUBLE))) AS pa FROM cp) SELECT p_partkey, id, {_s('log10(pa)', 6)} AS log10_pa FROM a JOIN pt USING (id)",
    "fuller_diffusion": f"WITH {_COMPOUNDS}, {views.PARTS}, a AS (SELECT id, mw, {_D} AS d FROM cp), b AS (SELECT *, 1e-6::DOUBLE / (4 * pi() * d * 0.1::DOUBLE) AS c FROM a) SELECT p_partkey, id, {_s('d * 1e6', 6)} AS d_mm2, {_s('c', 6)} AS c, {_s('c * sqrt(8.314::DOUBLE * 298.15::DOUBLE / (2 * pi() * mw / 1000))', 5)} AS i FROM b JOIN pt USING (id)",
}
