"""Molecules as tables: tokens, atoms, bonds, rings and contribution groups of SMILES, and the properties that follow from them.

A molecule is a text; each distinct one is worked out once, and its atoms and bonds are rows. Branches are nesting levels: an atom hangs
on the last atom before it in its own branch, or on the one before the branch, and ring digits pair up by their order. The atoms on
which an atom hangs, directly or not, are those whose branch encloses it, so the ring that a closing bond makes is found by a join
of the bond's ends with the atoms that enclose either of them but not both. Everything else counts neighbours.

Cases: a NULL, empty or malformed text has no properties but an error; repeated texts share one result; texts are trimmed of white
space. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Atomic weights.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.99, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Se": 78.971, "Br": 79.904, "I": 126.904}
#: Base and contributions to the boiling point in K, by group.
BASE_K = 198.2
GROUPS_K = {
    "-CH3": 23.58, "-CH2-": 22.88, ">CH-": 21.74, ">C<": 18.25, "=CH2": 18.18, "=CH-": 24.96, "=C<": 24.14, "=C=": 26.15, "C#CH": 9.2, "C#C-": 27.38,
    "-CH2- (ring)": 27.15, ">CH- (ring)": 21.78, ">C< (ring)": 21.32, "=CH- (ring)": 26.73, "=C< (ring)": 31.01, "-F": -0.03, "-Cl": 38.13, "-Br": 66.86, "-I": 93.84,
    "-OH (alcohol)": 92.88, "-OH (phenol)": 76.34, "-O- (nonring)": 22.42, "-O- (ring)": 31.22, ">C=O (nonring)": 76.75, ">C=O (ring)": 94.97, "O=CH- (aldehyde)": 72.24, "-COOH (acid)": 169.09, "-COO- (ester)": 81.1, "=O (other)": -10.5,
    "-NH2": 73.23, ">NH (nonring)": 50.17, ">NH (ring)": 52.82, ">N- (nonring)": 11.74, "-N= (nonring)": 74.6, "-N= (ring)": 57.55, "=NH": 83.08, "-CN": 125.66, "-NO2": 152.54, "-SH": 63.56, "-S- (nonring)": 68.78, "-S- (ring)": 52.1,
}
TOKEN = r"\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]|[-=#:/\\.]|\(|\)|%\d\d|\d"
BRACKET = r"^\[\d*([A-Z][a-z]?|[a-z]{1,2})@{0,2}(?:TH\d|AL\d)?(H\d*)?([+-]\d*|\++|-+)?(?::\d+)?\]$"
VALENCE = {"B": 3, "C": 4, "N": 3, "O": 2, "P": 3, "S": 2, "F": 1, "Cl": 1, "Br": 1, "I": 1}
ORDERS = {"-": 1, "=": 2, "#": 3, ":": 1, "/": 1, "\\": 1}


@dataclass(frozen=True)
class Group:
    """A contribution group: its central atom, what must stand next to it, and which neighbours belong to the group.

    A neighbour is described by its bond and element (-O, =O, #N) and by what else holds of it: H (bears hydrogen),
    link (bears none and has a second bond), aromatic, oxo (has a double bond to oxygen). Without a name the atom counts for nothing.
    """

    name: str | None
    element: str
    h: tuple[int, ...] = ()  # hydrogens; any number if empty
    bonds: tuple[int, ...] = ()
    ring: bool | None = None
    aromatic: bool | None = None
    has: tuple[str, ...] = ()  # neighbours that are all there, each another one
    lacks: tuple[str, ...] = ()
    takes: tuple[str, ...] = ()


#: The method's groups; an atom belongs to the first that fits.
GROUPS = (
    Group("=CH- (ring)", "C", h=(1,), aromatic=True, lacks=("=O",)),
    Group("=C< (ring)", "C", aromatic=True, lacks=("=O",)),
    Group("-CN", "C", has=("#N",)),
    Group("C#CH", "C", h=(1,), has=("#",)),
    Group("C#C-", "C", has=("#",)),
    Group("-COOH (acid)", "C", has=("=O", "-O H"), takes=("=O", "-O H")),
    Group(None, "C", has=("=O", "-O", "-O")),
    Group("-COO- (ester)", "C", h=(0,), has=("=O", "-O link"), takes=("=O", "-O link")),
    Group("O=CH- (aldehyde)", "C", h=(1,), bonds=(2,), has=("=O", "C"), takes=("=O",)),
    Group(">C=O (ring)", "C", h=(0,), bonds=(3,), ring=True, has=("=O",), takes=("=O",)),
    Group(">C=O (nonring)", "C", h=(0,), bonds=(3,), has=("=O",), takes=("=O",)),
    Group(None, "C", has=("=O",)),
    Group("=C=", "C", has=("=", "=")),
    Group("=CH- (ring)", "C", h=(1,), ring=True, has=("=",)),
    Group("=C< (ring)", "C", ring=True, has=("=",)),
    Group("=C<", "C", h=(0,), has=("=",)),
    Group("=CH-", "C", h=(1,), has=("=",)),
    Group("=CH2", "C", has=("=",)),
    Group(">C< (ring)", "C", h=(0,), ring=True),
    Group(">CH- (ring)", "C", h=(1,), ring=True),
    Group("-CH2- (ring)", "C", h=(2,), ring=True),
    Group(">C<", "C", h=(0,), ring=False),
    Group(">CH-", "C", h=(1,), ring=False),
    Group("-CH2-", "C", h=(2,), ring=False),
    Group("-CH3", "C", ring=False),
    Group("-OH (phenol)", "O", h=(1, 2), bonds=(1,), has=("aromatic",)),
    Group("-OH (alcohol)", "O", h=(1, 2), bonds=(1,)),
    Group(None, "O", h=(0,), bonds=(2,), has=("C oxo",)),
    Group("-O- (ring)", "O", h=(0,), bonds=(2,), ring=True),
    Group("-O- (nonring)", "O", h=(0,), bonds=(2,)),
    Group("-NO2", "N", bonds=(2, 3, 4), has=("=O",)),
    Group(None, "N", has=("#",)),
    Group("-NH2", "N", h=(2,)),
    Group(">NH (ring)", "N", h=(1,), ring=True),
    Group(">NH (nonring)", "N", h=(1,)),
    Group(None, "N", h=(3, 4)),
    Group("-N= (ring)", "N", bonds=(0, 1, 2), ring=True, aromatic=True),
    Group("-N= (ring)", "N", bonds=(0, 1, 2), ring=True, has=("=",)),
    Group("-N= (nonring)", "N", bonds=(0, 1, 2), aromatic=True),
    Group("-N= (nonring)", "N", bonds=(0, 1, 2), has=("=",)),
    Group(">N- (nonring)", "N"),
    Group("-SH", "S", h=(1, 2)),
    Group("-S- (ring)", "S", h=(0,), bonds=(2,), ring=True),
    Group("-S- (nonring)", "S", h=(0,), bonds=(2,)),
    *(Group(f"-{x}", x) for x in ("F", "Cl", "Br", "I")),
)


SCHEMA = "id string, molecular_weight double, boiling_point_c double, groups array<string>, redox_active boolean, non_redox boolean, gas boolean, error string"
_FAR = 1 << 30


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _total(x: Column) -> Column:
    """Sum of a molecule's few terms with what each addition loses carried along, so that their order doesn't count."""

    def add(a: Column, v: Column) -> Column:
        s = a["s"] + v
        lost = F.when(F.abs(a["s"]) >= F.abs(v), (a["s"] - s) + v).otherwise((v - s) + a["s"])
        return F.struct(s.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(F.array_sort(F.collect_list(x)), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda a: a["s"] + a["c"])


def _rounded(x: Column, scale: int) -> Column:
    """x rounded to 1 / scale, a half to even; what the product of x and the scale loses is carried, so only true halves count as such."""
    twice = x * float(2 * scale)
    far = x * 134217729.0
    high = far - (far - x)
    lost = (high * float(2 * scale) - twice) + (x - high) * float(2 * scale)
    n = F.floor(twice / 2)
    over = (twice - (n * 2 + 1)) + lost
    return (n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)) / scale


def tokens(molecules: DataFrame) -> DataFrame:
    """smiles, text, pos, token and the token before, a row per token of each molecule."""
    listed = molecules.select("smiles", F.trim("smiles").alias("text")).select("smiles", "text", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    return listed.repartition("smiles").withColumn("before", F.lag("token").over(Window.partitionBy("smiles").orderBy("pos")))


def _entries(toks: DataFrame) -> DataFrame:
    """Tokens with their branch: an opening bracket is also a member of the branch around it, and ends at its closing one."""
    depth = F.sum(F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)).over(Window.partitionBy("smiles").orderBy("pos"))
    kind = F.when(F.col("token").rlike(r"^[\[A-Za-z]"), "atom").when(F.col("token").rlike(r"\d"), "digit").when(F.col("token") == ".", "dot").otherwise("bond")
    t = toks.withColumn("depth", depth)
    part = lambda level, name: F.struct(level.cast("int").alias("level"), F.lit(name).alias("kind"))
    d = F.col("depth")
    roles = F.when(F.col("token") == "(", F.array(part(d, "open"), part(d - 1, "branch"))).when(F.col("token") == ")", F.array(part(d + 1, "close"))).otherwise(F.array(F.struct(d.cast("int").alias("level"), kind.alias("kind"))))
    e = t.select("smiles", "text", "pos", "token", "before", "depth", F.inline(roles))
    level = Window.partitionBy("smiles", "level").orderBy("pos")
    e = e.withColumn("branch", F.coalesce(F.max(F.when(F.col("kind") == "open", F.col("pos"))).over(level.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)))
    return e.withColumn("closed", F.min(F.when(F.col("kind") == "close", F.col("pos"))).over(level.rowsBetween(0, Window.unboundedFollowing)))


def _linked(entries: DataFrame) -> DataFrame:
    """Members of branches with link, the atom that they hang on (-1 behind a dot), and end, where what hangs on them ends."""
    inside = Window.partitionBy("smiles", "level", "branch").orderBy("pos")
    m = entries.where("kind NOT IN ('open', 'close')")
    link = F.last(F.when(F.col("kind") == "atom", F.col("pos")).when(F.col("kind") == "dot", -1), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    dot = F.min(F.when(F.col("kind") == "dot", F.col("pos"))).over(inside.rowsBetween(1, Window.unboundedFollowing))
    m = m.withColumns({"link": link, "end": F.least(F.coalesce(dot, F.lit(_FAR)), F.coalesce("closed", F.lit(_FAR)))})
    around = m.where("kind = 'branch'").select("smiles", F.col("pos").alias("branch"), F.col("link").alias("outer"))
    return m.join(around, ["smiles", "branch"], "left").withColumn("link", F.coalesce("link", F.when(F.col("kind") == "atom", F.col("outer")))).drop("outer")


def graph(molecules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms (smiles, atom, element, aromatic, fixed_h, parent, end), bonds in both directions (smiles, a, b, order), and faults by smiles."""
    toks = tokens(molecules)
    m = _linked(_entries(toks))
    order = _map(ORDERS, F.col("before"))
    bracket = F.col("token").startswith("[")
    symbol = F.when(bracket, F.regexp_extract("token", BRACKET, 1)).otherwise(F.col("token"))
    count = F.regexp_extract("token", BRACKET, 2)
    hydrogens = F.when(bracket, F.when(count == "", 0).when(count == "H", 1).otherwise(F.substring(count, 2, 9).try_cast("int")))
    atoms = m.where("kind = 'atom'").select("smiles", F.col("pos").alias("atom"), F.initcap(symbol).alias("element"), (symbol == F.lower(symbol)).alias("aromatic"), hydrogens.alias("fixed_h"), F.col("link").alias("parent"), F.coalesce(order, F.lit(1)).alias("order"), "end", F.col("level"))
    first = F.row_number().over(Window.partitionBy("smiles", "token").orderBy("pos"))
    digits = m.where("kind = 'digit'").select("smiles", "token", "pos", "link", order.alias("order"), first.alias("k")).withColumn("pair", F.floor((F.col("k") + 1) / 2))
    ends = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("link", F.lit(-1)).alias("link"), F.coalesce("order", F.lit(0)).alias("order"))))
    rings = digits.groupBy("smiles", "token", "pair").agg(ends.alias("e"))
    closing = rings.where("size(e) = 2").select("smiles", F.col("e")[0]["link"].alias("a"), F.col("e")[1]["link"].alias("b"), F.coalesce(F.nullif(F.col("e")[1]["order"], F.lit(0)), F.nullif(F.col("e")[0]["order"], F.lit(0)), F.lit(1)).alias("order"), F.lit(True).alias("closes"))
    hung = atoms.where("parent >= 0").select("smiles", F.col("parent").alias("a"), F.col("atom").alias("b"), "order", F.lit(False).alias("closes"))
    one = hung.unionByName(closing)
    bonds = one.unionByName(one.select("smiles", F.col("b").alias("a"), F.col("a").alias("b"), "order", "closes"))

    chars = toks.groupBy("smiles").agg(F.sum(F.length("token")).alias("read"), F.first(F.length("text")).alias("length"))
    levels = _entries(toks).groupBy("smiles").agg(F.min("depth").alias("low"), F.max_by("depth", F.struct("pos", "kind")).alias("left"))
    known = _map(dict.fromkeys(WEIGHTS, 1), F.col("element"))
    odd = atoms.groupBy("smiles").agg(F.count_if(known.isNull() | F.col("fixed_h").isNull() & ~F.col("element").isin(*VALENCE)).alias("strange"), F.count_if(F.col("parent").isNull() & (F.col("level") > 0)).alias("loose"))
    open_rings = rings.groupBy("smiles").agg(F.count_if((F.size("e") != 2) | F.exists("e", lambda x: x["link"] < 0)).alias("open"))
    f = molecules.select("smiles").join(chars, "smiles", "left").join(levels, "smiles", "left").join(odd, "smiles", "left").join(open_rings, "smiles", "left")
    wrong = (
        F.when(F.coalesce(F.col("read") != F.col("length"), F.lit(True)) | F.col("strange").isNull(), "can't read the text").when((F.col("low") < 0) | (F.col("left") != 0) | (F.col("loose") > 0), "unbalanced branches")
        .when(F.col("open") > 0, "a ring isn't closed").when(F.col("strange") > 0, "an atom isn't known")
    )
    return atoms.drop("order", "level"), bonds, f.select("smiles", wrong.alias("error"))


def ring_atoms(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """smiles and atom of all atoms in rings: those on the way between the ends of a closing bond."""
    closing = bonds.where("closes AND a < b").select("smiles", "a", "b")
    encloses = lambda x: (F.col("atom") <= F.col(x)) & (F.col("end") > F.col(x))
    on = closing.join(atoms.select("smiles", "atom", "end"), "smiles").withColumns({"of_a": encloses("a"), "of_b": encloses("b")}).where("of_a OR of_b")
    deepest = F.max(F.when(F.col("of_a") & F.col("of_b"), F.col("atom"))).over(Window.partitionBy("smiles", "a", "b"))
    return on.withColumn("deepest", deepest).where("of_a <> of_b OR atom = deepest").select("smiles", "atom").distinct()


def aromatic_bonds(atoms: DataFrame, bonds: DataFrame, rings: DataFrame) -> DataFrame:
    """smiles, a and b of the bonds of six-rings of carbon and nitrogen whose double bonds alternate, in both directions."""
    may = atoms.where("element IN ('C', 'N')").join(rings, ["smiles", "atom"]).select("smiles", "atom")
    inside = bonds.join(may.withColumnRenamed("atom", "a"), ["smiles", "a"]).join(may.withColumnRenamed("atom", "b"), ["smiles", "b"]).select("smiles", "a", "b", "order")
    double = inside.where("order = 2").select("smiles", F.col("a").alias("u"), F.col("b").alias("v"))
    single = inside.where("order = 1").select("smiles", F.col("a").alias("v"), F.col("b").alias("w"))
    step = double.join(single, ["smiles", "v"])  # u = v - w
    name = lambda k: step.select("smiles", F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}"), F.col("w").alias(f"u{k % 3 + 1}"))
    found = name(1).join(name(2), ["smiles", "u2"]).join(name(3), ["smiles", "u3", "u1"])
    ring = F.array("u1", "v1", "u2", "v2", "u3", "v3")
    found = found.where(F.size(F.array_distinct(ring)) == 6).select("smiles", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(F.get(ring, k).alias("a"), F.get(ring, (k + 1) % 6).alias("b")))).alias("s"))
    some = found.select("smiles", "s.a", "s.b")
    return some.unionByName(some.select("smiles", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _holds(pattern: str) -> Column:
    """Whether a bond's neighbour is as a Group describes it."""
    out = F.lit(True)
    for what in pattern.split():
        if what in ("H", "link", "aromatic", "oxo"):
            out = out & F.col(f"is_{what}")
        else:
            sign, element = (what[0], what[1:]) if what[0] in "-=#" else ("", what)
            if sign:
                out = out & (F.col("order") == "-=#".index(sign) + 1)
            if element:
                out = out & (F.col("near") == element)
    return out


_PATTERNS = sorted({w for g in GROUPS for w in (*g.has, *g.lacks, *g.takes)})


def _fits(g: Group) -> Column:
    own = F.col("element") == g.element
    own = own & F.col("h").isin(*g.h) if g.h else own
    own = own & F.col("degree").isin(*g.bonds) if g.bonds else own
    own = own & (F.col("ring") == g.ring) if g.ring is not None else own
    own = own & (F.col("aromatic") == g.aromatic) if g.aromatic is not None else own
    for w in set(g.has):
        own = own & (F.col(f"n_{_PATTERNS.index(w)}") >= g.has.count(w))
    for w in g.lacks:
        own = own & (F.col(f"n_{_PATTERNS.index(w)}") == 0)
    return own


def describe(rows: DataFrame, smiles: str = "smiles", out: str = "d") -> DataFrame:
    """rows with a struct of the properties of their SMILES (SCHEMA); error says why there are none."""
    from vapora.sources import scratch

    molecules = rows.select(F.col(smiles).alias("smiles")).where("smiles IS NOT NULL").distinct()
    atoms, bonds, faults = (scratch.stored(df, name) for df, name in zip(graph(scratch.stored(molecules, "molecules")), ("atoms", "bonds", "faults")))
    sound = faults.where("error IS NULL").select("smiles")
    atoms, bonds = atoms.join(sound, "smiles", "left_semi"), bonds.join(sound, "smiles", "left_semi")
    rings = scratch.stored(ring_atoms(atoms, bonds), "rings")
    alternating = scratch.stored(aromatic_bonds(atoms, bonds, rings), "alternating")
    bonds = bonds.join(alternating.withColumn("evened", F.lit(True)), ["smiles", "a", "b"], "left").withColumn("order", F.when(F.col("evened"), 1).otherwise(F.col("order"))).select("smiles", "a", "b", "order")
    turned = alternating.select("smiles", F.col("a").alias("atom"), F.lit(True).alias("turned")).distinct()
    atoms = atoms.join(rings.withColumn("ring", F.lit(True)), ["smiles", "atom"], "left").join(turned, ["smiles", "atom"], "left")
    atoms = atoms.select("smiles", "atom", "element", (F.col("aromatic") | F.coalesce("turned", F.lit(False))).alias("aromatic"), "fixed_h", F.coalesce("ring", F.lit(False)).alias("ring"))
    element = atoms.select("smiles", F.col("atom").alias("b"), F.col("element").alias("near"))
    per = bonds.join(element, ["smiles", "b"]).groupBy("smiles", F.col("a").alias("atom")).agg(
        F.count("*").alias("degree"), F.sum("order").alias("orders"), F.max("order").alias("most"), F.count_if(F.col("near") != "H").alias("heavy"), F.count_if((F.col("order") == 2) & (F.col("near") == "O")).alias("oxo"), F.count_if((F.col("order") == 2) & (F.col("near") == "C")).alias("doubles"),
    )
    a = atoms.join(per, ["smiles", "atom"], "left").na.fill(0, ["degree", "orders", "most", "heavy", "oxo", "doubles"])
    free = F.when(F.col("aromatic"), F.when(F.col("element") == "C", F.greatest(F.lit(0), 3 - F.col("heavy"))).otherwise(0)).otherwise(F.greatest(F.lit(0), _map(VALENCE, F.col("element")) - F.col("orders")))
    a = scratch.stored(a.withColumn("h", F.coalesce("fixed_h", free).cast("int")), "atoms")

    facts = a.select("smiles", F.col("atom").alias("b"), F.col("element").alias("near"), (F.col("h") > 0).alias("is_H"), ((F.col("h") == 0) & (F.col("degree") > 1)).alias("is_link"), F.col("aromatic").alias("is_aromatic"), (F.col("oxo") > 0).alias("is_oxo"))
    told = scratch.stored(bonds.join(facts, ["smiles", "b"]).select("smiles", "a", "b", *(_holds(w).alias(f"p_{k}") for k, w in enumerate(_PATTERNS))), "neighbours")
    counts = told.groupBy("smiles", F.col("a").alias("atom")).agg(*(F.count_if(f"p_{k}").alias(f"n_{k}") for k in range(len(_PATTERNS))))
    g = a.join(counts, ["smiles", "atom"], "left").na.fill(0, [f"n_{k}" for k in range(len(_PATTERNS))])
    group = F.coalesce(*(F.when(_fits(x), n) for n, x in enumerate(GROUPS)))
    g = scratch.stored(g.select("smiles", "atom", group.alias("group")), "groups")
    takes = F.coalesce(*(F.when(F.col("group") == n, F.expr(" OR ".join(f"p_{_PATTERNS.index(w)}" for w in x.takes))) for n, x in enumerate(GROUPS) if x.takes))
    taken = told.join(g.withColumnRenamed("atom", "a"), ["smiles", "a"]).where(takes).select("smiles", F.col("b").alias("atom")).distinct()
    name = F.get(F.array(*(F.lit(x.name) for x in GROUPS)), F.col("group"))
    own = g.join(taken, ["smiles", "atom"], "left_anti").select("smiles", name.alias("name")).where("name IS NOT NULL")
    own = own.groupBy("smiles", "name").agg(F.count("*").alias("k"))
    slight = ("=O (other)", "-F", "-Cl", "-Br", "-I")
    of = lambda *names: F.sum(F.when(F.col("name").isin(*names), F.col("k")).otherwise(0))
    named = {"carboxylic acid": "-COOH (acid)", "ester": "-COO- (ester)", "aldehyde": "O=CH- (aldehyde)", "alcohol": "-OH (alcohol)", "phenol": "-OH (phenol)", "ether": "-O- (nonring)", "thiol": "-SH"}
    groups = own.groupBy("smiles").agg(_total(F.col("k") * _map(GROUPS_K, F.col("name"))).alias("kelvin"), F.sum(F.when(~F.col("name").isin(*slight), F.col("k")).otherwise(0)).alias("telling"), of(">C=O (nonring)", ">C=O (ring)").alias("ketones"), *(of(key).alias(n) for n, key in named.items()))
    carbon, sulfur = F.col("element") == "C", F.col("element") == "S"
    whole = a.groupBy("smiles").agg(
        _total(_map(WEIGHTS, F.col("element")) + F.col("h") * WEIGHTS["H"]).alias("mass"), F.count("*").alias("n"), F.count_if(carbon).alias("carbons"), F.count_if("aromatic").alias("aromatic"), F.count_if((F.col("element") == "O") & F.col("aromatic")).alias("furan"),
        F.count_if((F.col("element") == "N") & (F.col("oxo") == 0) & ~F.col("aromatic") & (F.col("most") <= 1)).alias("amine"), F.count_if(sulfur).alias("sulfur"), F.count_if(sulfur & (F.col("degree") == 2) & ~F.col("aromatic")).alias("thioether"),
        F.count_if(carbon & (F.col("doubles") > 0)).alias("alkene"), F.max("most").alias("most"),
    )
    m = whole.join(groups, "smiles", "left").na.fill(0)
    some = [F.when((F.col(n) > 0) & (F.col("carbons") > 0), n) for n in named] + [F.when(F.col("ketones") > 0, "ketone"), F.when(F.col("ketones") > 1, "diketone")] + [F.when(F.col(n) > 0, n) for n in ("aromatic", "furan", "amine", "sulfur", "thioether", "alkene")]
    m = m.withColumn("groups", F.array_sort(F.array_compact(F.array(*some))))
    alkane = (F.size("groups") == 0) & (F.col("carbons") == F.col("n")) & (F.col("most") <= 1)
    organic = (F.col("telling") > 0) & (F.col("carbons") > 0)
    celsius = (F.lit(BASE_K) + F.col("kelvin")) - 273.15
    plain = F.trim("smiles")
    m = m.select(
        "smiles", F.concat(F.lit("inf-"), F.left(F.sha1(plain), F.lit(10))).alias("id"), _rounded(F.col("mass"), 100).alias("molecular_weight"), _rounded(celsius, 10).alias("boiling_point_c"), F.when(alkane, F.array(F.lit("alkane"))).otherwise(F.col("groups")).alias("groups"),
        organic.alias("redox_active"), F.when(~organic, ~plain.isin("O", "O=O", "N#N", "[NH3]")).alias("non_redox"), (celsius < 25.0).alias("gas"),
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    told = faults.join(m, "smiles", "left").select("smiles", F.struct(*names).alias("_d"))
    none = F.struct(*(F.lit("can't read the text" if n == "error" else None).cast(kind).alias(n) for n, kind in (c.split(" ", 1) for c in SCHEMA.split(", "))))
    # the properties are a row for each distinct molecule; Spark broadcasts them if they are few
    return rows.join(told, rows[smiles] == told["smiles"], "left").select(*(rows[c] for c in rows.columns), F.coalesce("_d", none).alias(out))
