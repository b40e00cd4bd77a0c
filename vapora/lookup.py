"""Command line: the feasibility of a substance by name, SMILES or mixture. 0 found, 2 a wrong call, 3 nothing found."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import catalogue
from vapora.operators import feasibility, molecules, search


def parse_mix(text: str) -> list[tuple[str, float]]:
    """Names and weights of `a:0.6,b:0.4`; ValueError for anything else."""
    parts = [p.strip().rpartition(":") for p in text.split(",")]
    if any(not name or not re.fullmatch(r"\d*\.?\d+", weight.strip()) for name, _, weight in parts):
        raise ValueError(f"can't read mixture {text!r}")
    return [(name.strip(), float(weight)) for name, _, weight in parts]


def _found(spark: SparkSession, names: list[str]) -> dict[str, tuple[str, str]]:
    rows = search.exact_resolve(spark.createDataFrame([(n,) for n in names], "q string"), search.dictionary(spark)).collect()
    return {r["q"]: (r["kind"], r["id"]) for r in rows}


def verdict(spark: SparkSession, text: str) -> DataFrame | None:
    """Verdict rows of a name, else of a SMILES; None where it is neither."""
    hit = _found(spark, [text]).get(text)
    if hit:
        return feasibility.resolve(spark, hit[1], hit[0])
    made = molecules.from_smiles(spark.createDataFrame([(text,)], "smiles string"))
    return None if made.isEmpty() else feasibility.constituent_chain(made)


def mix_verdict(spark: SparkSession, parts: list[tuple[str, float]]) -> DataFrame | None:
    """Verdict of a mixture of names and SMILES; None where a member is unknown."""
    hits = _found(spark, [n for n, _ in parts])
    extra = molecules.from_smiles(spark.createDataFrame([(n,) for n, _ in parts if n not in hits] or [("C",)], "smiles string"))
    ids = {n: i for n, (k, i) in hits.items() if k == "chemical"} | {r["smiles"]: r["id"] for r in extra.select("smiles", "id").collect()}
    if any(n not in ids for n, _ in parts):
        return None
    row = [(0, "mix", "Mixture", "mix", [], [(ids[n], w, "measured") for n, w in parts])]
    return feasibility.composite_verdict(spark.createDataFrame(row, catalogue.composites(spark).schema), catalogue.compounds(spark).unionByName(extra))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lookup")
    p.add_argument("name", nargs="?")
    p.add_argument("--mix")
    p.add_argument("--library", default="")
    try:
        a = p.parse_args(args)
        parts = parse_mix(a.mix) if a.mix else None
    except (SystemExit, ValueError) as e:
        return 2 if isinstance(e, ValueError) or e.code else 0
    if bool(a.name) == bool(parts):
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    found = mix_verdict(spark, parts) if parts else verdict(spark, a.name)
    if found is None:
        return 3
    r = feasibility.guidance(found).first()
    print(f"{r['name']}: {r['verdict']} (confidence {r['confidence']}), signal {r['signal_strength']}, response {r['response_speed']}, exposure {r['exposure_s']} s, dilution {r['dilution']}")
    if a.library:
        lib = spark.createDataFrame([(x.strip(),) for x in a.library.split(",")], "label string")
        check = feasibility.cross_check(catalogue.compounds(spark).where(F.col("id") == r["id"]), lib).first()
        print(f"may be confused with: {', '.join(check['confusable']) or 'none'}" if check else "may be confused with: unknown")
    return 0
