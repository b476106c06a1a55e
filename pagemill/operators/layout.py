"""Where a table lies on a page: lines and blocks of a page as arrays, and boxes found among them.

A page's lines are gathered once, in reading order, into one row; a page is small, whatever the number
of pages. Everything else is worked out within that row, without a shuffle. Lines and blocks are structs
of y0, x0, x1, y1, text, folded, in the order of y0 and x0. Boxes are structs of lo and hi, or null."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import fold, loose_keyword, loosen
from pagemill.operators.geometry import clamp_box, least_hits


@dataclass(frozen=True)
class Words:
    """Folded phrases that the layout rules look for; the reference languages' own lists can be given."""

    header: dict[str, str] = field(default_factory=lambda: {"asset": "actif", "liability": "passif"})
    header_endings: tuple[str, ...] = ("", " ifrs", " social", " consolide", " consolidee", " sociaux", " consolides")
    split_titles: tuple[str, ...] = ("bilan actif", "bilan passif", "bilan social", "bilan (actif)", "bilan (passif)", "compte de produits", "comptes de produits", "compte de resultat", "etat du resultat", "etat des soldes", "tableau des flux", "flux de tresorerie", "cpc")
    neighbour_titles: tuple[str, ...] = ("capacite d'autofinancement", "capacite d autofinancement")
    income_starts: tuple[str, ...] = ("compte de resultat", "compte de produits", "etat du resultat", "cpc")
    income_titles: tuple[str, ...] = ("compte de produits et charges", "compte de resultat", "etat du resultat", "etat de resultat")
    beside_income: tuple[str, ...] = ("flux de tresorerie", "tableau des flux", "variation des capitaux propres", "perimetre de consolidation", "tableau de financement", "attestation")
    income_rows: tuple[str, ...] = ("total", "produit", "charge", "resultat", "marge", "impot", "dotation", "reprise", "interet", "commission", "chiffre", "exercice", "brut", "net")
    income_anchors: tuple[str, ...] = ("interets et produits assimiles", "produit net bancaire", "cout du risque", "resultat net", "produits d'exploitation", "charges d'exploitation", "total des produits", "total des charges")
    boundaries: tuple[str, ...] = ("hors bilan", "tableau des flux", "notes annexes", "etat des soldes", "compte de produits")
    ends: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"asset": ("total actif", "total de l'actif"), "liability": ("total passif", "total du passif"), "income": ("resultat net", "resultat de l'exercice")})
    before: tuple[str, ...] = ("bilan ifrs", "bilan consolide", "bilan au", "etat de la situation financiere")
    rows_below: tuple[tuple[str, ...], ...] = (("capitaux propres", "capital social", "dettes envers"), ("valeurs en caisse", "creances", "immobilisations"))
    amounts: tuple[str, ...] = ("en milliers de dirhams", "en milliers de dh")
    flows: tuple[str, ...] = ("tableau des flux", "flux de tresorerie")
    not_main: tuple[str, ...] = ("note annexe", "detail des postes", "ventilation")
    other_statement: tuple[str, ...] = ("tableau des flux", "etat des soldes")
    not_a_block: tuple[str, ...] = ("hors bilan", "notes annexes")
    not_a_statement: tuple[str, ...] = ("tableau de financement", "flux de tresorerie", "capacite d'autofinancement")
    statement_titles: tuple[str, ...] = ("bilan actif", "bilan passif", "bilan consolide", "bilan social", "compte de produits", "compte de resultat", "etat du resultat")
    titles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"asset": ("bilan actif", "actif"), "liability": ("bilan passif", "passif"), "income": ("compte de produits et charges", "compte de resultat")})
    anchors: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"asset": ("creances", "immobilisations", "stocks", "valeurs en caisse"), "liability": ("capital social", "dettes envers", "provisions", "depots"), "income": ("chiffre d'affaires", "charges d'exploitation", "resultat courant", "produits financiers")})


WORDS = Words()
OTHER = {"asset": "liability", "liability": "asset"}


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def starts_with(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(text, F.lit(w))
    return out


def lines_of_spans(spans: DataFrame, page: list[str], line: str, order: str) -> DataFrame:
    """One row for each line of a page: its spans' texts in order, joined by spaces, with their box;
    lines without text are left out."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), " ")
    rows = spans.groupBy(*page, line).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.trim(text).alias("text"))
    return rows.filter("text <> ''").withColumn("folded", fold(F.col("text")))


def filled(blocks: DataFrame) -> DataFrame:
    """Blocks that hold more than white space."""
    return blocks.filter(F.coalesce("text", F.lit("")).rlike(r"\S"))


def gathered(lines: DataFrame, page: list[str], name: str = "lines") -> DataFrame:
    """A row for each page with its lines in reading order."""
    rows = lines if "folded" in lines.columns else lines.withColumn("folded", fold(F.col("text")))
    return rows.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")), "text", "folded"))).alias(name))


def middle(line: Column) -> Column:
    return (line["x0"] + line["x1"]) / 2


def box(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def in_column(line: Column, bounds: Column, slack: float) -> Column:
    """Whether a line's middle lies within bounds; null bounds hold everything."""
    return bounds.isNull() | middle(line).between(bounds["lo"] - slack, bounds["hi"] + slack)


def is_header(folded: Column, word: str, words: Words = WORDS) -> Column:
    return folded.isin(*(word + e for e in words.header_endings)) | (F.replace(folded, F.lit(" "), F.lit("")) == word) | starts_with(folded, (f"{word} (", f"{word} au "))


def is_split_title(folded: Column, words: Words = WORDS) -> Column:
    return starts_with(folded, words.split_titles)


def is_neighbour_title(folded: Column, words: Words = WORDS) -> Column:
    return starts_with(folded, words.split_titles + words.neighbour_titles)


def has_title(folded: Column, target: str, words: Words = WORDS) -> Column:
    """Whether a text is or holds a title of the target."""
    if target == "income":
        return starts_with(folded, words.income_starts + words.income_titles)
    word = words.header[target]
    return any_of(folded, (f"bilan {word}", f"bilan ({word})", f"{word} ifrs")) | (folded == word) | F.startswith(folded, F.lit(f"{word} ("))


def is_boundary(folded: Column, target: str, words: Words = WORDS) -> Column:
    """Whether a line ends the table above it: what never does comes first, then the other side's word
    alone or at the start, then phrases anywhere."""
    ends = any_of(folded, words.boundaries)
    if target == "income":
        return ends
    own, other = words.header[target], words.header[OTHER[target]]
    side = (folded == other) | F.startswith(folded, F.lit(f"{other} "))
    if target == "asset":
        return side | ends
    row = F.startswith(folded, F.lit(f"autres {other}")) | (F.contains(folded, F.lit("gains et pertes")) & F.contains(folded, F.lit("capitaux propre")))
    return F.when(row, False).otherwise(ends | (side & ~F.contains(folded, F.lit(own))))


def _found(head: Column, plain: Column, words: Words) -> dict[str, Column]:
    """How many anchors of each target a block's folded head holds, and which titles."""
    def hits(own) -> Column:
        out = F.lit(0)
        for w in own:
            test = F.contains(head, F.lit(w))
            if len(w.split()) > 1:
                test = test | F.contains(plain, F.lit(loose_keyword(w)))
            out = out + test.cast("int")
        return out

    return {f"n_{t}": hits(a) for t, a in words.anchors.items()} | {f"t_{t}": hits(a) > 0 for t, a in words.titles.items()}


def _type(head: Column, found, words: Words) -> Column:
    """found: gives what _found() found, by name."""
    n, titled = ({t: found(f"{k}_{t}") for t in ("asset", "liability", "income")} for k in ("n", "t"))
    by_anchors = F.when((n["asset"] >= 2) & (n["asset"] >= n["liability"]) & (n["asset"] >= n["income"]), "asset").when((n["liability"] >= 2) & (n["liability"] >= n["income"]), "liability").when(n["income"] >= 2, "income")
    place = lambda t: F.call_function("locate", F.lit(words.header[t]), head)
    both = F.when(n["asset"] > n["liability"], "asset").when(n["liability"] > n["asset"], "liability").when(place("asset") <= place("liability"), "asset").otherwise("liability")
    none = any_of(head, words.not_a_block) | (any_of(head, words.not_a_statement) & ~any_of(F.substring(head, 1, 220), words.statement_titles))
    named = F.when(titled["asset"] & titled["liability"], both).when(titled["asset"], "asset").when(titled["liability"], "liability").when(titled["income"], "income")
    return F.when(~none, F.coalesce(named, by_anchors))


#: Characters of a block that its type is taken from.
HEAD = 600


def with_block_type(blocks: DataFrame, text: str, words: Words = WORDS) -> DataFrame:
    """Adds type to a row for each block: asset, liability, income or null, from its first HEAD characters: what no
    statement has, titles, else the target with most anchors of two or more (the first on ties). A block with the
    titles of both sides is of the side with more anchors, then of the one whose word comes first."""
    head = F.col("_head")
    rows = blocks.withColumn("_head", fold(F.substring(text, 1, HEAD))).withColumn("_plain", loosen(head))
    found = {f"_{k}": c for k, c in _found(head, F.col("_plain"), words).items()}
    return rows.withColumns(found).withColumn("type", _type(head, lambda k: F.col(f"_{k}"), words)).drop("_head", "_plain", *found)


def typed(blocks: Column, words: Words = WORDS) -> Column:
    """Blocks of an array with their type, as with_block_type() has it. Within an array nothing is worked out once
    for several uses, so what several tests read is put into the structs first, step by step."""
    own = lambda b: [b[c].alias(c) for c in ("y0", "x0", "x1", "y1", "text", "folded")]
    heads = F.transform(blocks, lambda b: F.struct(*own(b), F.when(F.length(b["text"]) <= HEAD, b["folded"]).otherwise(fold(F.substring(b["text"], 1, HEAD))).alias("head")))
    plains = F.transform(heads, lambda b: F.struct(*own(b), b["head"].alias("head"), loosen(b["head"]).alias("plain")))
    found = F.transform(plains, lambda b: F.struct(*own(b), b["head"].alias("head"), F.struct(*(c.alias(k) for k, c in _found(b["head"], b["plain"], words).items())).alias("found")))
    return F.transform(found, lambda b: F.struct(*own(b), _type(b["head"], lambda k: b["found"][k], words).alias("type")))


def headers(lines: Column, target: str, words: Words = WORDS) -> Column:
    return F.filter(lines, lambda x: is_header(x["folded"], words.header[target], words))


def side_by_side(lines: Column, target: str, width: Column, words: Words = WORDS) -> Column:
    """The half of the page that holds the target, where headers of both sides stand beside each other: the
    nearest pair, at most 40 apart in height and a fifth of the width or more across."""
    pairs = F.flatten(
        F.transform(
            headers(lines, "asset", words),
            lambda a, i: F.transform(headers(lines, "liability", words), lambda b, j: F.struct(F.abs(a["y0"] - b["y0"]).alias("dy"), i.alias("i"), j.alias("j"), middle(a).alias("a"), middle(b).alias("b"))),
        )
    )
    best = F.array_min(pairs)
    split = F.greatest((best["a"] + best["b"]) / 2, width * 0.5)
    fine = (best["dy"] <= 40) & (F.abs(best["a"] - best["b"]) >= width * 0.2)
    return F.when(fine, box(F.lit(0.0), split) if target == "asset" else box(split, width))


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["folded"]), " ")


def first_best(items: Column, value) -> Column:
    """The item with the largest value, the first on ties."""
    return F.array_max(F.transform(items, lambda x, i: F.struct(value(x).cast("double").alias("v"), (-i).alias("i"), x.alias("x"))))["x"]


def best_header(lines: Column, found: Column, target: str, words: Words = WORDS) -> Column:
    """The header whose surroundings look most like a balance sheet: 90 points above and 260 below."""
    total = words.ends[target]

    def value(h: Column) -> Column:
        above = joined(F.filter(lines, lambda x: x["y0"].between(h["y0"] - 90, h["y0"])))
        below = joined(F.filter(lines, lambda x: (x["y0"] > h["y0"]) & (x["y0"] <= h["y0"] + 260)))
        points = F.when(any_of(above, words.before), 3.0).otherwise(0.0) + F.when(any_of(below, total), 3.0).otherwise(0.0)
        if target == "liability":
            points = points + F.when(any_of(above, words.ends["asset"]), 2.5).otherwise(0.0)
        for group in words.rows_below:
            points = points + F.when(any_of(below, group), 1.0).otherwise(0.0)
        return points - F.when((h["y0"] < 180) & ~any_of(above, words.before[:-1]), 2.0).otherwise(0.0)

    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(first_best(found, value))


def single_column(lines: Column, header: Column, width: Column, words: Words = WORDS) -> Column:
    """The header's part of the page where another statement's title stands on the other half."""
    half = width / 2
    near = F.filter(lines, lambda x: (x["y0"] >= header["y0"] - 50) & is_neighbour_title(x["folded"], words))
    right = F.array_min(F.transform(F.filter(near, lambda x: middle(x) > half - 5), lambda x: x["x0"]))
    left = F.array_max(F.transform(F.filter(near, lambda x: middle(x) < half + 5), lambda x: x["x1"]))
    at = middle(header)
    return F.when((at < half - 20) & right.isNotNull(), box(F.lit(0.0), F.greatest(width * 0.35, right - 8))).when((at > half + 20) & left.isNotNull(), box(F.least(width * 0.65, left + 8), width))


def column_of_blocks(lines: Column, blocks: Column, y_start: Column, width: Column, target: str, words: Words = WORDS) -> Column:
    """The half of the page that the target's blocks stand on, if the other half holds a statement's title.
    Their place is the mean middle of the titles near the start: of those that name the balance sheet, else
    of any, else of all blocks there."""
    near = F.filter(blocks, lambda b: F.abs(b["y0"] - y_start) <= 28)
    titled = F.filter(near, lambda b: has_title(b["folded"], target, words))
    full = F.filter(titled, lambda b: F.contains(b["folded"], F.lit("bilan")))
    chosen = F.when(F.size(full) > 0, full).when(F.size(titled) > 0, titled).otherwise(near)
    center = F.aggregate(chosen, F.lit(0.0), lambda s, b: s + middle(b)) / F.nullif(F.size(chosen), F.lit(0))
    half = width / 2
    below = F.filter(lines, lambda x: x["y0"] >= F.greatest(y_start - 40, F.lit(0.0)))
    left, right = F.filter(below, lambda x: middle(x) < half - 20), F.filter(below, lambda x: middle(x) > half + 20)
    split = lambda part: F.exists(part, lambda x: is_split_title(x["folded"], words))
    both = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(both & (center < half - 20) & split(right), box(F.lit(0.0), half)).when(both & (center > half + 20) & split(left), box(half, width))


def title_side(lines: Column, y_start: Column, width: Column, words: Words = WORDS) -> Column:
    """left or right: where an income statement's title near the start begins; null without one."""
    first = F.array_min(F.transform(F.filter(lines, lambda x: (F.abs(x["y0"] - y_start) < 45) & starts_with(x["folded"], words.income_titles)), lambda x: x["x0"]))
    return F.when(first > width * 0.45, "right").when(first.isNotNull(), "left")


def boundary_below(lines: Column, y_start: Column, bounds: Column, width: Column, target: str, words: Words = WORDS) -> Column:
    """The top of the first line below the start that ends the table; of an income statement, lines on the
    other side of the page than its title don't count."""
    side = title_side(lines, y_start, width, words) if target == "income" else F.lit(None).cast("string")
    across = lambda x: F.when(side == "left", middle(x) > width * 0.45).when(side == "right", middle(x) < width * 0.45).otherwise(False)
    found = F.filter(lines, lambda x: (x["y0"] > y_start + 8) & in_column(x, bounds, 5) & ~across(x) & is_boundary(x["folded"], target, words))
    return F.array_min(F.transform(found, lambda x: x["y0"]))


def end_anchor(lines: Column, y_start: Column, bounds: Column, max_y: Column, target: str, words: Words = WORDS) -> Column:
    """The lowest bottom of a total or result line above max_y."""
    found = F.filter(lines, lambda x: (x["y0"] > y_start + 8) & in_column(x, bounds, 5) & F.coalesce(x["y0"] < max_y, F.lit(True)) & any_of(x["folded"], words.ends[target]))
    return F.array_max(F.transform(found, lambda x: x["y1"]))


def typed_boundary(blocks: Column, y_start: Column, bounds: Column, height: Column, target: str, words: Words = WORDS) -> Column:
    """The top of the first block, over 12 points below the start, that is titled as another statement; else
    the page's height. blocks have a `type`."""
    other = lambda b: F.coalesce(b["type"] != target, F.lit(False)) & F.coalesce(_titled(b, words), F.lit(False))
    found = F.filter(blocks, lambda b: (b["y0"] > y_start + 12) & in_column(b, bounds, 5) & other(b))
    return F.coalesce(F.array_min(F.transform(found, lambda b: b["y0"])), height)


def _titled(block: Column, words: Words) -> Column:
    out = F.lit(None).cast("boolean")
    for t in ("asset", "liability", "income"):
        out = F.when(block["type"] == t, has_title(block["folded"], t, words)).otherwise(out)
    return out


def bottom(height: Column, typed: Column, line: Column, anchor: Column) -> Column:
    """Where the table ends, from the first boundary and the last total. typed: what typed_boundary() found, null where
    blocks weren't looked at."""
    first = F.coalesce(F.least(typed, line), height)  # nulls don't count
    with_anchor = F.when(first <= anchor, F.least(height, anchor + 4)).when(first < height, F.least(anchor + 4, first - 2)).otherwise(anchor + 4)
    return F.when(anchor.isNotNull(), with_anchor).when(first < height, F.greatest(first - 2, F.lit(0.0))).otherwise(height - 20)


def densest(matched: Column, gap: float = 95) -> Column:
    """Of lines (y0, y1, label) in order, the run without a gap over `gap` that has most labels, then most
    lines, the first on ties; two lines or fewer are a run in any case."""
    item = "struct<y0:double,y1:double,label:string>"
    start = F.struct(F.expr(f"cast(array() as array<array<{item}>>)").alias("done"), F.expr(f"cast(array() as array<{item}>)").alias("run"))

    def step(s: Column, x: Column) -> Column:
        on = (F.size(s["run"]) == 0) | (x["y0"] - F.element_at(s["run"], -1)["y1"] <= gap)
        return F.struct(F.when(on, s["done"]).otherwise(F.concat(s["done"], F.array(s["run"]))).alias("done"), F.when(on, F.concat(s["run"], F.array(x))).otherwise(F.array(x)).alias("run"))

    runs = F.aggregate(matched, start, step, lambda s: F.concat(s["done"], F.array(s["run"])))
    best = F.array_max(F.transform(runs, lambda r, i: F.struct(F.size(F.array_distinct(F.transform(r, lambda x: x["label"]))).alias("n"), F.size(r).alias("m"), (-i).alias("i"), r.alias("r"))))["r"]
    return F.when(F.size(matched) <= 2, matched).otherwise(best)


def signature_region(lines: Column, labels: list[str], y_start: Column, max_y: Column, bounds: Column, target: str) -> Column:
    """y0, y1, hits, coverage of the dense run of lines with row labels (each line counts for the first label
    that it holds) from 45 above the start to 8 below max_y; null where too few labels are hit."""
    def label(folded: Column, loose: Column) -> Column:
        return F.coalesce(*(F.when(F.contains(folded, F.lit(name)) | F.contains(loose, F.lit(loose_keyword(name))), F.lit(name)) for name in labels))

    band = F.filter(lines, lambda x: (x["y1"] >= y_start - 45) & (x["y0"] <= max_y + 8) & in_column(x, bounds, 8))
    loosened = F.transform(band, lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), x["folded"].alias("folded"), loosen(x["folded"]).alias("loose")))
    matched = F.filter(F.transform(loosened, lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), label(x["folded"], x["loose"]).alias("label"))), lambda x: x["label"].isNotNull())
    hits = F.size(F.array_distinct(F.transform(matched, lambda x: x["label"])))
    cover = hits / F.lit(float(len(set(labels))))
    run = densest(matched)
    region = F.struct(F.array_min(F.transform(run, lambda x: x["y0"])).alias("y0"), F.array_max(F.transform(run, lambda x: x["y1"])).alias("y1"), hits.alias("hits"), cover.alias("coverage"))
    enough = (hits >= least_hits(F.lit(len(labels)), target == "income")) | (cover >= 0.35)
    return F.when((F.size(matched) > 0) & enough, region)


def absorbed(blocks: Column, y_start: Column, y_end: Column, start: Column, above: float = 5) -> Column:
    """The box `start` widened by every block in the band whose middle lies in it, one after the other, so
    that a later block meets what earlier ones have widened."""

    def step(s: Column, b: Column) -> Column:
        inside = b["y0"].between(y_start - above, y_end + 5) & middle(b).between(s["lo"] - 5, s["hi"] + 5)
        return F.when(inside, box(F.least(s["lo"], b["x0"]), F.greatest(s["hi"], b["x1"]))).otherwise(s)

    return F.aggregate(blocks, box(start["lo"], start["hi"]), step)


def income_columns(lines: Column, y_start: Column, y_end: Column, width: Column, words: Words = WORDS) -> Column:
    """The part of the page that an income statement's title and what stands to its right leave; or null."""
    first = F.get(F.filter(lines, lambda x: (F.abs(x["y0"] - y_start) < 45) & starts_with(x["folded"], words.income_titles)), F.lit(0))
    right = lambda frm: F.array_min(F.transform(F.filter(lines, lambda x: (x["y0"] > frm) & (x["y0"] < y_end) & (middle(x) > width * 0.45) & any_of(x["folded"], words.beside_income)), lambda x: x["x0"]))
    beside, below = right(y_start - 12), right(y_start + 10)
    left = F.when((first["x0"] < width * 0.25) & beside.isNotNull(), box(F.lit(0.0), beside - 8))
    other = F.when(below.isNotNull(), box(F.lit(0.0), below - 8))
    return F.when(first["x0"] > width * 0.45, box(F.greatest(first["x0"] - 8, F.lit(0.0)), width)).otherwise(F.coalesce(left, other))


def income_rows(lines: Column, y_start: Column, y_end: Column, width: Column, words: Words = WORDS) -> Column:
    """lo and hi of the lines in the band that look like rows (a row's word, or a digit); else of those with
    a digit."""
    foreign = lambda x: any_of(x["folded"], words.beside_income) & (middle(x) > width * 0.52)
    digit = lambda x: x["text"].rlike("[0-9]")
    extent = lambda rows: box(F.array_min(F.transform(rows, lambda x: x["x0"])), F.array_max(F.transform(rows, lambda x: x["x1"])))
    rows = F.filter(lines, lambda x: x["y0"].between(y_start + 10, y_end) & (F.length(F.trim(x["folded"])) >= 3) & (any_of(x["folded"], words.income_rows) | digit(x)) & ~foreign(x))
    other = F.filter(lines, lambda x: x["y0"].between(y_start + 15, y_end) & (F.length(F.trim(x["text"])) >= 2) & digit(x) & ~foreign(x))
    return F.when(F.size(rows) > 0, extent(rows)).when(F.size(other) > 0, extent(other))


def widened_by_rows(start: Column, rows: Column, width: Column) -> Column:
    """The box widened to its rows with a margin."""
    pad = F.least(F.lit(28.0), F.greatest(F.lit(12.0), width * 0.035))
    lo = F.when(rows.isNull(), start["lo"]).otherwise(F.least(start["lo"], F.greatest(rows["lo"] - pad, F.lit(0.0))))
    lo = F.when(lo > rows["lo"] + 80, F.greatest(F.least(F.lit(20.0), width * 0.04), rows["lo"] - pad)).otherwise(lo)
    hi = F.when(rows.isNull(), start["hi"]).otherwise(F.greatest(start["hi"], F.least(rows["hi"] + pad, width)))
    return box(lo, hi)


def column_of_titles(titles: Column, own: Column, y_start: Column, width: Column) -> Column:
    """Of typed blocks that start within 24 points of the table's, the strip around the only one of the
    target: up to the middles between neighbouring titles; null unless there are two titles or more."""
    row = F.array_sort(F.filter(titles, lambda b: F.abs(b["y0"] - y_start) <= 24), lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    mine = F.filter(own, lambda b: F.abs(b["y0"] - y_start) <= 24)
    centers = F.transform(row, middle)
    at = F.array_position(F.transform(centers, lambda c: F.abs(c - middle(F.get(mine, F.lit(0)))) < 1), F.lit(True)).cast("int")
    left = F.when(at == 1, F.lit(0.0)).otherwise((F.get(centers, at - 2) + F.get(centers, at - 1)) / 2)
    right = F.when(at == F.size(row), width).otherwise((F.get(centers, at - 1) + F.get(centers, at)) / 2)
    return F.when((F.size(mine) == 1) & (F.size(row) >= 2) & (at > 0), box(left, right))


def balance_confidence(confidence: Column, lines: Column, top: Column, low: Column, y_start: Column, words: Words = WORDS) -> Column:
    """Caps for small regions, notes and other statements' context."""
    height = F.greatest(low - top, F.lit(0.0))
    page = joined(lines)
    other_context, alternate = any_of(page, words.not_main), any_of(page, words.other_statement)
    early = F.slice(F.filter(lines, lambda x: x["y0"] <= y_start + 45), 1, 8)
    main = F.exists(early, lambda x: x["folded"].isin(*words.header.values()) | starts_with(x["folded"], ("bilan au", *(f"bilan {w}" for w in words.header.values()))))
    caps = [(height < 130, 0.70), (other_context & ~main, 0.72), (other_context & (height < 180), 0.62), (alternate, 0.58)]
    out = confidence
    for when, cap in caps:
        out = F.when(when, F.least(out, F.lit(cap))).otherwise(out)
    return out


def best_income_header(lines: Column, words: Words = WORDS) -> Column:
    """The income statement's title that is followed by most of its rows within 420 points."""
    found = F.filter(lines, lambda x: starts_with(x["folded"], words.income_starts))

    def value(h: Column) -> Column:
        below = joined(F.filter(lines, lambda x: (x["y0"] > h["y0"]) & (x["y0"] <= h["y0"] + 420)))
        hits = F.lit(0)
        for w in words.income_anchors:
            hits = hits + F.contains(below, F.lit(w)).cast("int")
        named = F.when(F.contains(h["folded"], F.lit("compte de resultat ifrs")), 4.0).otherwise(0.0) + F.when(F.contains(h["folded"], F.lit("compte de produits")), 3.0).otherwise(0.0)
        return named + F.when(any_of(below, words.amounts), 1.5).otherwise(0.0) + F.least(hits, F.lit(6)) - F.when(any_of(below, words.flows), 0.5).otherwise(0.0)

    return first_best(found, value)


def localized(pages: DataFrame, target: str, labels: list[str], words: Words = WORDS) -> DataFrame:
    """Adds table (x0, y0, x1, y1), confidence, way (header, blocks, page, or none) and titled (no title is missing
    from the blocks it was found by) to pages with lines, blocks, width, height, score and scope_score: by the line of a header, else by the target's blocks, else
    the whole page. Pages that break a balance sheet down by currency have no table."""
    rows = pages.withColumn("_blocks", typed(F.col("blocks"), words))
    lines, blocks, width, height = F.col("lines"), F.col("_blocks"), F.col("width").cast("double"), F.col("height").cast("double")
    balance = target != "income"
    if balance:
        found = headers(lines, target, words)
        social = F.filter(lines, lambda x: F.startswith(x["folded"], F.lit("bilan social")))
        fallback = F.slice(social, 1, 1) if target == "asset" else F.when(F.size(social) >= 2, F.slice(social, 2, 1)).otherwise(F.slice(social, 1, 0))
        rows = rows.withColumn("_found", F.when(F.size(found) > 0, found).otherwise(fallback)).withColumn("_beside", side_by_side(lines, target, width, words))
        rows = rows.withColumn("_found", F.filter("_found", lambda x: in_column(x, F.col("_beside"), 5)))
        rows = rows.withColumn("_header", best_header(lines, F.col("_found"), target, words))
    else:
        rows = rows.withColumn("_beside", F.lit(None).cast("struct<lo:double,hi:double>")).withColumn("_header", best_income_header(lines, words))
    own = F.filter(blocks, lambda b: F.coalesce(b["type"] == target, F.lit(False)))
    rows = rows.withColumn("_own", own)
    by_header, by_blocks = F.col("_header").isNotNull(), F.size("_own") > 0
    if balance:
        currency = F.substring(joined(lines), 1, 4500)
        rows = rows.withColumn("_none", F.contains(currency, F.lit("ventilation")) & F.contains(currency, F.lit("devise")))
    else:
        rows = rows.withColumn("_none", F.lit(False))
    rows = rows.withColumn("way", F.when(F.col("_none"), "none").when(by_header, "header").when(by_blocks, "blocks").otherwise("page"))
    rows = rows.withColumn("_y", F.when(by_header, F.col("_header.y0")).otherwise(F.array_min(F.transform("_own", lambda b: b["y0"]))))
    y = F.col("_y")
    if balance:
        beside = F.coalesce(F.col("_beside"), F.when(by_header, single_column(lines, F.col("_header"), width, words)).otherwise(column_of_blocks(lines, F.col("_own"), y, width, target, words)))
        rows = rows.withColumn("_beside", beside)
    column = F.col("_beside")
    rows = rows.withColumn("_line", boundary_below(lines, y, column, width, target, words))
    rows = rows.withColumn("_anchor", end_anchor(lines, y, column, F.col("_line"), target, words))
    other = typed_boundary(blocks, y, column, height, target, words)
    rows = rows.withColumn("_typed", other if balance else F.when(by_header, height).otherwise(other))
    rows = rows.withColumn("_end", bottom(height, F.col("_typed"), F.col("_line"), F.col("_anchor")))
    rows = rows.withColumn("_region", signature_region(lines, labels, y, F.col("_end"), column, target))
    region, padding = F.col("_region"), 12.0 if balance else 16.0
    rows = rows.withColumn("_end", F.when(region.isNull(), F.col("_end")).otherwise(F.greatest(F.col("_end"), F.least(height, region["y1"] + padding)))).withColumn("_y", F.when(region.isNull(), y).otherwise(F.least(y, region["y0"])))
    end = F.col("_end")
    wide = box(F.lit(0.0), width)
    extent = box(F.array_min(F.transform("_own", lambda b: b["x0"])), F.array_max(F.transform("_own", lambda b: b["x1"])))
    strip = column_of_titles(F.filter(blocks, lambda b: b["type"].isNotNull()), F.col("_own"), y, width)
    start = F.coalesce(column, F.when(by_header, wide).otherwise(F.coalesce(strip, extent)))
    if not balance:
        start = F.coalesce(income_columns(lines, y, end, width, words), F.when(by_header, wide).otherwise(F.coalesce(strip, extent)))
    rows = rows.withColumn("_x", start)
    if not balance:
        rows = rows.withColumn("_x", widened_by_rows(F.col("_x"), income_rows(lines, y, end, width, words), width))
    rows = rows.withColumn("_x", absorbed(blocks, y, end, F.col("_x"), 8 if balance else 5))
    if balance:
        rows = rows.withColumn("_x", F.when(column.isNull(), F.col("_x")).otherwise(box(F.greatest(F.col("_x.lo"), column["lo"]), F.least(F.col("_x.hi"), column["hi"]))))
    right = F.when(column.isNotNull() & by_header, 2.0).otherwise(8.0)
    inner = clamp_box(F.col("_x.lo") - 8, F.greatest(y - 10, F.lit(0.0)), F.col("_x.hi") + right, F.least(height, end), width, height)
    whole = clamp_box(width * 0.04, height * 0.08, width - width * 0.04, height * 0.94, width, height)
    rows = rows.withColumn("table", F.when(F.col("way").isin("header", "blocks"), inner).when(F.col("way") == "page", whole))
    score = F.col("score")
    title = F.exists("_own", lambda b: has_title(b["folded"], target, words))
    rows = rows.withColumn("titled", (F.col("way") != "blocks") | title)
    lined = F.least(F.lit(0.98), 0.78 + 0.20 * score) if balance else F.least(F.lit(0.99), 0.84 + 0.15 * score)
    blocked = F.least(F.lit(0.99), 0.70 + 0.29 * score)
    capped = lambda c: F.when(F.col("scope_score") <= 0, F.least(c, F.lit(0.45))).otherwise(c)
    blocked = capped(blocked)
    blocked = F.when(title, blocked).otherwise(F.least(blocked, F.lit(0.68 if balance else 0.35)))
    rows = rows.withColumn("confidence", F.when(F.col("way") == "header", capped(lined) if balance else lined).when(F.col("way") == "blocks", blocked).when(F.col("way") == "page", F.greatest(F.lit(0.25), F.least(score, F.lit(0.65)))))
    if balance:
        rows = rows.withColumn("confidence", F.when(F.col("way").isin("header", "blocks"), balance_confidence(F.col("confidence"), lines, F.col("table.y0"), F.col("table.y1"), y, words)).otherwise(F.col("confidence")))
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def text_within(lines: Column, table: Column) -> Column:
    """The texts of the lines whose middle lies in a box, in reading order."""
    inside = F.filter(lines, lambda x: middle(x).between(table["x0"], table["x1"]) & ((x["y0"] + x["y1"]) / 2).between(table["y0"], table["y1"]))
    return F.array_join(F.transform(inside, lambda x: x["text"]), "\n")


def crop_pixels(table: Column, width: Column, height: Column, pixels_wide: Column, pixels_high: Column, pad: float = 12) -> Column:
    """The box in pixels: padded, at least 22 hundredths of the page wide and 8 high, truncated to whole
    pixels; the whole page where nothing is left."""
    x0, y0, x1, y1 = (table[c] for c in ("x0", "y0", "x1", "y1"))
    x0, y0, x1, y1 = F.greatest(x0 - pad, F.lit(0.0)), F.greatest(y0 - pad, F.lit(0.0)), F.least(x1 + pad, width), F.least(y1 + pad, height)
    x1, y1 = F.greatest(x1, F.least(x0 + width * 0.22, width)), F.greatest(y1, F.least(y0 + height * 0.08, height))
    sx, sy = pixels_wide / width, pixels_high / height
    a, b, c, d = (v.cast("int") for v in (x0 * sx, y0 * sy, x1 * sx, y1 * sy))
    fine = (c > a) & (d > b)
    return F.struct(F.when(fine, a).otherwise(0).alias("left"), F.when(fine, b).otherwise(0).alias("top"), F.when(fine, c).otherwise(pixels_wide.cast("int")).alias("right"), F.when(fine, d).otherwise(pixels_high.cast("int")).alias("bottom"))


def holds_other_table(lines: Column, table: Column, forbidden) -> Column:
    """Whether the text within a box holds a phrase of another table, so that the target has to be taken out
    of a combined crop."""
    return any_of(fold(text_within(lines, table)), forbidden)
