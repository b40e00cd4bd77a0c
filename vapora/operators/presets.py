"""Presets: named rig configurations, read from a strict block-YAML subset, validated and offered as a table."""

from __future__ import annotations

import argparse
import json
import re
import sys
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vapora.functions import sensors
from vapora.operators.features import feature_names

#: What marks a group's features, groups that depend on cadence, defaults of thresholds and baseline, roles.
GROUP_MARKERS = {"device_agnostic": "_da_", "absolute": "_abs_", "temporal": "_temp_", "health": "_health_", "hardware": "_hw_", "saturation": "_advanced_", "decay": "_decay_", "selectivity": "sel_ratio_", "global": "global_"}
CADENCE_GROUPS = ("temporal", "decay")
THRESHOLDS = {"dead_noise_ceiling": 0.02, "drift_abs_floor": 0.001, "drift_rel_ceiling": 0.01}
BASELINE = {"duration_s": 1800.0, "settling_s": 300.0}
ROLES, TYPES = ("primary", "supporting", "cross_sensitivity"), ("mox", "miris", "electrochemical", "other", "unknown")
class PresetError(ValueError):
    """A preset is malformed; the message says where."""


class PresetNotFoundError(PresetError):
    """No preset has this id."""


@dataclass
class Preset:
    id: str
    sensors: list[dict]
    feature_groups: list[str]
    cadence_hz: float
    name: str = ""
    description: str = ""
    sensor_type: str = "mox"
    context_columns: list[str] = field(default_factory=list)
    baseline: dict = field(default_factory=dict)
    thresholds: dict = field(default_factory=dict)
    false_alarm_budget: dict | None = None
    provisional: list[str] = field(default_factory=list)
    cadence_period_s: float | None = None
    cadence_rationale: str = ""
    notes: str = ""
    source: str = ""

    @property
    def r0_samples(self) -> int:
        b = BASELINE | self.baseline
        return int(b["r0_samples"]) if b.get("r0_samples") is not None else max(1, round(b["duration_s"] * self.cadence_hz))

    @property
    def least_duration_s(self) -> float:
        return 2.0 / self.cadence_hz

    def limits(self) -> dict[str, float]:
        return THRESHOLDS | {k: v for k, v in self.thresholds.items() if k in THRESHOLDS}

    def feature_names(self) -> list[str]:
        """Names that the requested groups select from the framework's."""
        marks = [GROUP_MARKERS[g] for g in self.feature_groups]
        return [n for n in feature_names(len(self.sensors)) if any(m in n for m in marks)]

    def advisories(self) -> list[str]:
        """What to know before deploying; none of it is an error."""
        out = ["timing: cadence_below_1hz"] if self.cadence_hz < 1 else []
        touchy = [g for g in CADENCE_GROUPS if g in self.feature_groups]
        if touchy and self.least_duration_s > 60:
            out.append(f"cadence: {', '.join(touchy)} requested, but nothing under {self.least_duration_s:g} s is resolved")
        if len(self.sensors) < 2 and "selectivity" in self.feature_groups:
            out.append("selectivity: ratios need two channels")
        if self.r0_samples < 2:
            out.append(f"baseline: {self.r0_samples} sample at this cadence")
        if self.limits()["dead_noise_ceiling"] >= 0.5:
            out.append("thresholds: the dead-noise ceiling condemns only a channel without any response")
        return out

    def validate(self) -> Preset:
        where = self.source or f"preset {self.id!r}"

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise PresetError(f"{where}: {what}")

        snake = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*")
        need(bool(snake.fullmatch(self.id)), f"id {self.id!r} isn't snake case")
        need(not self.source or Path(self.source).stem == self.id, f"id {self.id!r} isn't the file's name")
        need(self.sensor_type in TYPES, f"sensor_type {self.sensor_type!r} is none of {TYPES}")
        need(self.cadence_hz > 0, "the cadence must be positive")
        need(bool(self.sensors), "no sensors")
        need(bool(self.feature_groups), "no feature groups")
        need(set(self.feature_groups) <= set(GROUP_MARKERS), f"unknown feature groups {sorted(set(self.feature_groups) - set(GROUP_MARKERS))}")
        need(len(set(self.feature_groups)) == len(self.feature_groups), "a feature group repeats")
        names = feature_names(len(self.sensors))
        need(all(any(GROUP_MARKERS[g] in n for n in names) for g in self.feature_groups), "a feature group has no feature for this many channels")
        ids = [s.get("id") for s in self.sensors]
        need(len(set(ids)) == len(ids), "a channel id repeats")
        tabulated = {m: (r, {g for g, _, _ in gs}) for m, _, r, gs in sensors._rows()}
        for s in self.sensors:
            need(bool(snake.fullmatch(str(s.get("id")))), f"channel id {s.get('id')!r} isn't snake case")
            need(s.get("role", "primary") in ROLES, f"role {s.get('role')!r} is none of {ROLES}")
            need(s.get("r0") is None or s["r0"] > 0, f"r0 of {s['id']} must be positive")
            need(s.get("r0") is not None or not s.get("r0_source"), f"r0_source of {s['id']} without r0")
            model = {sensors.key(m): m for m in tabulated}.get(sensors.key(str(s.get("model"))))
            need(model is not None, f"model {s.get('model')!r} isn't tabulated")
            ratio, gases = tabulated[model]
            need(set(s.get("targets") or []) <= gases or not gases, f"targets {sorted(set(s.get('targets') or []) - gases)} of {s['id']} aren't tabulated for {model}")
            given = s.get("clean_air_ratio")
            need(given is None or (ratio is not None and abs(given - ratio) <= 1e-6), f"clean_air_ratio of {s['id']} isn't {ratio}")
        need(self.limits() == THRESHOLDS or bool(self.thresholds.get("basis")), "thresholds that aren't the defaults need a basis")
        for path in self.provisional:
            try:
                resolve_field(vars(self), path)
            except KeyError:
                need(False, f"provisional field {path!r} doesn't exist")
        return self


def resolve_field(value: object, path: str) -> object:
    """The value at a dotted path with indexes, such as sensors[0].model; KeyError where there is none."""
    for name, index in re.findall(r"([A-Za-z_]\w*)|\[(\d+)\]", path):
        try:
            value = value[int(index)] if index else value[name]  # type: ignore[index]
        except (KeyError, IndexError, TypeError) as e:
            raise KeyError(path) from e
    return value


# --- the YAML subset -------------------------------------------------------


def _scalar(text: str, where: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[:1]:
        if len(text) < 2 or text[-1] != text[0]:
            raise PresetError(f"{where}: unclosed quote")
        body = text[1:-1]
        return json.loads(f'"{body}"') if text[0] == '"' else body.replace("''", "'")
    if text.startswith("["):
        if not text.endswith("]"):
            raise PresetError(f"{where}: unclosed list")
        return [_scalar(x, where) for x in re.findall(r"\s*(\"[^\"]*\"|'[^']*'|[^,]+)\s*(?:,|$)", text[1:-1])]
    if text[:1] in ("{", "&", "*", "!"):
        raise PresetError(f"{where}: {text[0]} isn't part of the subset")
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _uncommented(line: str) -> str:
    return re.sub(r"^((?:[^\"'#]|\"[^\"]*\"|'[^']*'|(?<=\S)#)*?)(?:(?:^|\s)#.*)?$", r"\1", line).rstrip()


def parse_yaml(text: str, where: str = "text") -> dict:
    """A mapping from block YAML: mappings, sequences, scalars, folded and literal blocks. Anything else raises with its line."""
    lines = text.splitlines()
    at = 0

    def peek() -> tuple[int, str] | None:
        nonlocal at
        while at < len(lines) and not _uncommented(lines[at]).strip():
            at += 1
        if at == len(lines):
            return None
        line = _uncommented(lines[at])
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise PresetError(f"{where}:{at + 1}: a tab indents")
        return len(line) - len(line.lstrip()), line.strip()

    def block(indent: int, fold: bool) -> str:
        nonlocal at
        out = []
        while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
            out.append(lines[at].strip())
            at += 1
        while out and not out[-1]:
            out.pop()
        return (re.sub(r" *\n+ *", "\n", " ".join(x or "\n" for x in out)) if fold else "\n".join(out)) + "\n"

    def value(rest: str, indent: int) -> object:
        if rest[:1] in (">", "|") and rest.rstrip("-+")[1:] == "":
            got = block(indent, rest[0] == ">")
            return got.rstrip("\n") if rest.endswith("-") else got
        if rest:
            return _scalar(rest, f"{where}:{at}")
        ahead = peek()
        return node(ahead[0]) if ahead and (ahead[0] > indent or (ahead[0] == indent and ahead[1].startswith("- "))) else None

    def node(indent: int) -> object:
        nonlocal at
        ahead = peek()
        if ahead and ahead[1].startswith("-"):
            items: list = []
            while (ahead := peek()) and ahead[0] == indent and ahead[1].startswith("-"):
                rest = ahead[1][1:].strip()
                if re.match(r"[A-Za-z_]\w*:(\s|$)", rest):
                    lines[at] = " " * (indent + 2) + rest
                    items.append(node(indent + 2))
                else:
                    at += 1
                    items.append(value(rest, indent))
            return items
        out: dict = {}
        while (ahead := peek()) and ahead[0] == indent:
            m = re.match(r"([A-Za-z_][\w-]*)\s*:(?:\s+(.*))?$", ahead[1])
            if not m:
                raise PresetError(f"{where}:{at + 1}: expected a key, got {ahead[1]!r}")
            if m[1] in out:
                raise PresetError(f"{where}:{at + 1}: key {m[1]!r} repeats")
            at += 1
            out[m[1]] = value((m[2] or "").strip(), indent)
        return out

    got = node(0) if peek() else {}
    if peek():
        raise PresetError(f"{where}:{at + 1}: unexpected indentation")
    if not isinstance(got, dict):
        raise PresetError(f"{where}: the top isn't a mapping")
    return got


_KEYS = {"id", "name", "description", "cadence_hz", "cadence_period_s", "cadence_rationale", "sensor_type", "sensors", "context_columns", "feature_groups", "baseline", "thresholds", "false_alarm_budget", "provisional", "notes"}
_SENSOR_KEYS = {"id", "model", "targets", "role", "clean_air_ratio", "r0", "r0_source", "note"}
_SUB_KEYS = {"baseline": {"duration_s", "settling_s", "warmup_s", "r0_samples", "method"}, "thresholds": {*THRESHOLDS, "basis"}, "false_alarm_budget": {"alarms_per_day", "rationale"}}


def build(raw: dict, source: str = "") -> Preset:
    """A validated preset from a mapping; unknown keys and wrong kinds raise."""

    def known(value: object, keys: set[str], what: str) -> dict:
        if not isinstance(value, dict) or set(value) - keys:
            raise PresetError(f"{source}: {what} has unknown keys {sorted(set(value) - keys)}" if isinstance(value, dict) else f"{source}: {what} isn't a mapping")
        return value

    known(raw, _KEYS, "the preset")
    if "id" not in raw or ("cadence_hz" in raw) == ("cadence_period_s" in raw):
        raise PresetError(f"{source}: a preset needs an id and one of cadence_hz and cadence_period_s")
    rate = raw.get("cadence_hz") or (1.0 / raw["cadence_period_s"] if raw.get("cadence_period_s") else 0)
    if not isinstance(rate, (int, float)) or isinstance(rate, bool):
        raise PresetError(f"{source}: the cadence isn't a number")
    for name, keys in _SUB_KEYS.items():
        for k, v in known(raw.get(name) or {}, keys, name).items():
            if k not in ("method", "basis", "rationale") and v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0):
                raise PresetError(f"{source}: {name}.{k} isn't a number of at least 0")
    rows = raw.get("sensors") or []
    if not isinstance(rows, list):
        raise PresetError(f"{source}: sensors isn't a list")
    text = lambda k: str(raw.get(k) or "").strip()
    return Preset(
        id=str(raw["id"]), name=text("name"), description=text("description"), sensors=[known(s, _SENSOR_KEYS, "a sensor") for s in rows], feature_groups=list(raw.get("feature_groups") or []), cadence_hz=float(rate), sensor_type=raw.get("sensor_type", "mox"),
        context_columns=list(raw.get("context_columns") or []), baseline=raw.get("baseline") or {}, thresholds=raw.get("thresholds") or {}, false_alarm_budget=raw.get("false_alarm_budget"), provisional=list(raw.get("provisional") or []),
        cadence_period_s=raw.get("cadence_period_s"), cadence_rationale=text("cadence_rationale"), notes=text("notes"), source=source,
    ).validate()


def shipped() -> list[Preset]:
    """The presets that come with the package, by id; they are read from an archive too."""
    files = [f for f in resources.files("vapora").joinpath("presets").iterdir() if f.name.endswith(".yaml")]
    return sorted((build(parse_yaml(f.read_text(), f.name), f.name) for f in files), key=lambda p: p.id)


def load_folder(path: str) -> list[Preset]:
    """Presets of a folder's YAML files, by id."""
    return sorted((build(parse_yaml(f.read_text(), str(f)), str(f)) for f in [*Path(path).glob("*.yaml"), *Path(path).glob("*.yml")]), key=lambda p: p.id)


def load(name: str, folder: str | None = None) -> Preset:
    for p in load_folder(folder) if folder else shipped():
        if p.id == name:
            return p
    raise PresetNotFoundError(f"no preset {name!r}")


def table(spark: SparkSession, presets: list[Preset] | None = None) -> DataFrame:
    """Presets as rows with their derived columns; place is their place by id."""
    rows = []
    for place, p in enumerate(sorted(presets if presets is not None else shipped(), key=lambda p: p.id)):
        lim = p.limits()
        rows.append((p.id, p.cadence_hz, 1 / p.cadence_hz, len(p.sensors), [s["model"] for s in p.sensors], p.context_columns, p.feature_groups, len(p.feature_names()), p.r0_samples, p.least_duration_s, *lim.values(), (p.false_alarm_budget or {}).get("alarms_per_day"), p.advisories(), (BASELINE | p.baseline).get("r0_samples"), float((BASELINE | p.baseline)["duration_s"]), place))
    return spark.createDataFrame(rows, "id string, cadence_hz double, cadence_period_s double, n_channels int, models array<string>, context array<string>, feature_groups array<string>, n_features int, r0_samples int, least_duration_s double, dead_noise_ceiling double, drift_abs_floor double, drift_rel_ceiling double, alarms_per_day double, advisories array<string>, declared_r0 int, baseline_s double, place int")


def sensor_table(spark: SparkSession, presets: list[Preset] | None = None) -> DataFrame:
    """The presets' channels as rows: id, ch_idx, channel, model, role, targets, clean_air_ratio, settling_s, warmup_s, provisional."""
    rows = [
        (p.id, k, s["id"], s["model"], s.get("role", "primary"), s.get("targets") or [], s.get("clean_air_ratio"), float((BASELINE | p.baseline)["settling_s"]), float(p.baseline.get("warmup_s") or 0), p.provisional)
        for p in (presets if presets is not None else shipped())
        for k, s in enumerate(p.sensors)
    ]
    return spark.createDataFrame(rows, "id string, ch_idx int, channel string, model string, role string, targets array<string>, clean_air_ratio double, settling_s double, warmup_s double, provisional array<string>")


def descriptor(p: Preset) -> dict:
    """The preset's array as a bundle's sensor descriptor."""
    return {"sensorType": p.sensor_type, "channels": [{"id": s["id"], "unit": "adc" if p.sensor_type == "mox" else ""} for s in p.sensors], "samplingRateHz": p.cadence_hz}


def main(args: list[str] | None = None) -> int:
    """list, show, validate [--strict] and field; 0 if all is well, 1 for a refusal, 2 for a wrong call."""
    parser = argparse.ArgumentParser(prog="presets")
    parser.add_argument("--folder")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("show", "validate", "field"):
        s = sub.add_parser(name)
        s.add_argument("id")
        if name == "field":
            s.add_argument("path")
        if name == "validate":
            s.add_argument("--strict", action="store_true")
    try:
        a = parser.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.command == "list":
            print("\n".join(f"{p.id}\t{p.cadence_hz:g} Hz\t{len(p.sensors)} channels" for p in (load_folder(a.folder) if a.folder else shipped())))
            return 0
        p = load(a.id, a.folder)
        if a.command == "show":
            print(json.dumps(vars(p) | {"r0_samples": p.r0_samples, "advisories": p.advisories()}, indent=2, default=str))
        elif a.command == "field":
            print(json.dumps(resolve_field(vars(p), a.path)))
        else:
            print("\n".join([f"{p.id}: valid", *p.advisories()]))
            return int(a.strict and bool(p.advisories()))
    except (PresetError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def advisories(hz: Column, groups: Column, channels: Column, r0_samples: Column, dead_ceiling: Column) -> Column:
    """Preset.advisories() of a rig as it is deployed."""
    touchy = F.filter(groups, lambda g: g.isin(*CADENCE_GROUPS))
    return F.array_compact(F.array(
        F.when(hz < 1, "timing: cadence_below_1hz"),
        F.when((F.size(touchy) > 0) & (2 / hz > 60), F.format_string("cadence: %s requested, but nothing under %.0f s is resolved", F.array_join(touchy, ", "), 2 / hz)),
        F.when((channels < 2) & F.array_contains(groups, "selectivity"), "selectivity: ratios need two channels"),
        F.when(r0_samples < 2, F.format_string("baseline: %d sample at this cadence", r0_samples)),
        F.when(dead_ceiling >= 0.5, "thresholds: the dead-noise ceiling condemns only a channel without any response"),
    ))


def resolved(rigs: DataFrame, presets: DataFrame) -> DataFrame:
    """rigs (any columns, preset, and where they depart from it hz and baseline_s) with what their presets make of them.

    r0_samples are the declared ones, else the baseline's seconds at the rig's cadence, one at least. A rig whose preset isn't known is left out.
    """
    p = presets.select(F.col("id").alias("preset"), F.col("cadence_hz").alias("preset_hz"), "n_channels", "models", "feature_groups", "n_features", "declared_r0", "baseline_s", "dead_noise_ceiling", "alarms_per_day", "place")
    r = rigs.withColumnRenamed("baseline_s", "own_baseline_s").join(F.broadcast(p), "preset")  # a row for each configuration file
    r = r.withColumn("hz", F.coalesce("hz", "preset_hz")).withColumn("baseline_s", F.coalesce("own_baseline_s", "baseline_s")).drop("own_baseline_s", "preset_hz")
    r = r.withColumn("r0_samples", F.coalesce("declared_r0", F.greatest(F.lit(1), F.bround(F.col("baseline_s") * F.col("hz")))).cast("int")).drop("declared_r0")
    r = r.withColumns({"period_s": 1 / F.col("hz"), "least_duration_s": 2 / F.col("hz")})
    return r.withColumn("advisories", advisories(F.col("hz"), F.col("feature_groups"), F.col("n_channels"), F.col("r0_samples"), F.col("dead_noise_ceiling")))


def _rigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as rigs of the shipped presets, some with a cadence or a baseline of their own, and their samples' count."""
    names = F.array(*map(F.lit, [p.id for p in shipped()]))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n_samples"))
    own = F.when(F.col("user_id") % 3 > 0, F.element_at(F.array(*map(F.lit, (0.02, 0.5, 4.0))), (F.col("user_id") % 3 + F.col("user_id") % 2).cast("int")))
    return e.select("user_id", "n_samples", F.element_at(names, (F.col("user_id") % F.size(names) + 1).cast("int")).alias("preset"), own.alias("hz"), F.when(F.col("user_id") % 5 == 0, F.lit(30.0)).alias("baseline_s"))


def _q_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolved(_rigs(spark, sf_dir), table(spark))
    return out.select("user_id", "preset", "place", "hz", "period_s", "n_channels", F.array_join("models", " ").alias("models"), F.array_join("feature_groups", " ").alias("feature_groups"), "n_features", "r0_samples", "least_duration_s", "dead_noise_ceiling", "alarms_per_day", (F.col("n_samples") >= F.col("r0_samples")).alias("enough"))


def _q_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(_rigs(spark, sf_dir), table(spark)).select("user_id", "preset", F.explode_outer("advisories").alias("advisory"))


def _q_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's preset with its channels, their laws' count, and what is provisional."""
    laws = sensors.power_laws(spark).select("model", F.col("gas").alias("target"))
    t = sensor_table(spark).withColumn("target", F.explode_outer("targets")).join(F.broadcast(laws.withColumn("law", F.lit(1))), ["model", "target"], "left")
    t = t.groupBy("id", "ch_idx", "channel", "role", "settling_s", "warmup_s", "clean_air_ratio").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"), F.count("law").alias("n_laws"))
    names = [p.id for p in shipped()]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("id"))
    return parts.join(F.broadcast(t), "id")


QUERIES = {"presets_resolved": _q_resolved, "preset_advisories": _q_advisories, "preset_sensors": _q_sensors}


def _sql(x: object) -> str:
    return "NULL" if x is None else f"{x}::DOUBLE" if isinstance(x, (int, float)) else "'" + str(x) + "'"


_ROWS = "p(id, period, models, groups, alarms) AS (VALUES " + ", ".join(f"({_sql(p.id)}, {_sql(1 / p.cadence_hz)}, {_sql(' '.join(s['model'] for s in p.sensors))}, {_sql(' '.join(p.feature_groups))}, {_sql((p.false_alarm_budget or {}).get('alarms_per_day'))})" for p in shipped()) + ")"
_RIGS = f"""{_ROWS}, o AS (SELECT *, row_number() OVER (ORDER BY id)::INT - 1 AS i FROM p),
rc AS (SELECT user_id, id, i, n_samples, CASE WHEN user_id % 3 > 0 THEN [0.02, 0.5, 4.0][user_id % 3 + user_id % 2]::DOUBLE ELSE 1 / period END AS hz, CASE WHEN user_id % 5 = 0 THEN 30 ELSE 1800 END AS s FROM (SELECT user_id, count(*) AS n_samples FROM events GROUP BY user_id) JOIN o ON user_id % {len(shipped())} = i),
rg AS (SELECT user_id, id, i, n_samples, hz, greatest(1, round_even(s * hz, 0))::INT AS r0 FROM rc)"""
_CHANNELS = "ch(i, id, ch_idx, channel, model, role, settling_s, ratio, targets) AS (VALUES " + ", ".join(
    f"({i}, {_sql(p.id)}, {k}, {_sql(s['id'])}, {_sql(s['model'])}, {_sql(s['role'])}, {_sql((BASELINE | p.baseline)['settling_s'])}, {_sql(s.get('clean_air_ratio'))}, [{', '.join(map(_sql, s.get('targets') or []))}]::VARCHAR[])" for i, p in enumerate(shipped()) for k, s in enumerate(p.sensors)
) + ")"
_LAWS = "lw(model, gas) AS (VALUES " + ", ".join(f"({_sql(m)}, {_sql(g)})" for m, _, _, gs in sensors._rows() for g, _, _ in gs) + ")"
_COUNT = "CASE g WHEN 'device_agnostic' THEN 6 * c WHEN 'absolute' THEN 4 * c WHEN 'temporal' THEN 4 * c WHEN 'health' THEN 4 * c WHEN 'hardware' THEN 3 * c WHEN 'saturation' THEN c WHEN 'decay' THEN 6 * c WHEN 'selectivity' THEN c * (c - 1) // 2 ELSE 4 END"
ORACLE_SQL = {
    "presets_resolved": f"""WITH {_RIGS}, n AS (SELECT *, len(string_split(models, ' ')) AS c FROM p), e AS (SELECT id, c, unnest(string_split(groups, ' ')) AS g FROM n), f AS (SELECT id, sum({_COUNT})::INT AS k FROM e GROUP BY id)
SELECT user_id, id AS preset, i AS place, hz, 1 / hz AS period_s, c::INT AS n_channels, models, groups AS feature_groups, k AS n_features, r0 AS r0_samples, 2 / hz AS least_duration_s, CASE WHEN id = 'gas_leak_fire_smoke' THEN 0.01 ELSE 0.02 END::DOUBLE AS dead_noise_ceiling, alarms AS alarms_per_day, n_samples >= r0 AS enough FROM rg JOIN n USING (id) JOIN f USING (id)""",
    "preset_sensors": f"""WITH {_CHANNELS}, {_LAWS} SELECT p_partkey, id, ch_idx, channel, role, settling_s, 172800::DOUBLE AS warmup_s, ratio AS clean_air_ratio, array_to_string(list_sort(targets), ',') AS targets, (SELECT count(*) FROM lw WHERE lw.model = ch.model AND list_contains(ch.targets, lw.gas)) AS n_laws
FROM part JOIN ch ON p_partkey % {len(shipped())} = i""",
    "preset_advisories": f"""WITH {_RIGS}, x AS (SELECT user_id, id, list_filter([CASE WHEN hz < 1 THEN 'timing: cadence_below_1hz' END, CASE WHEN 2 / hz > 60 AND (contains(groups, 'temporal') OR contains(groups, 'decay')) THEN 'cadence: ' || array_to_string(list_filter(string_split(groups, ' '), lambda g: g IN ('temporal', 'decay')), ', ') || ' requested, but nothing under ' || round(2 / hz)::INT || ' s is resolved' END,
  CASE WHEN NOT contains(models, ' ') AND contains(groups, 'selectivity') THEN 'selectivity: ratios need two channels' END, CASE WHEN r0 < 2 THEN 'baseline: ' || r0 || ' sample at this cadence' END], lambda a: a IS NOT NULL) AS a FROM rg JOIN p USING (id))
SELECT user_id, id AS preset, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END) AS advisory FROM x""",
}
