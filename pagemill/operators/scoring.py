"""The score of a page for a request (target, scope, sector): six weighted terms, then ordered rules.

What a page has is worked out once, for all targets and scopes; requests then meet narrow rows without
text. Rules are data: a step is a list of branches (condition, kind, amount), of which the first whose
condition holds is applied. Conditions and amounts are SQL over the columns named in TERMS, so a step can
be read, tested and replaced by itself. Vocabulary is a parameter; the one given here is this engine's."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import hit_sql
from pagemill.operators import statements
from pagemill.operators.marks import All, Any, Marks, Named, Rule, with_rules
from pagemill.operators.ordered import with_neighbours
from pagemill.operators.retrieval import coverage_sql, keep_or_all, structural_key, tiebreak, top_k
from pagemill.sources.shared import kept

TARGETS = ("asset", "liability", "income")
SCOPES = ("consolidated", "statutory")

# Weights of the terms, saturation and dense hits by target.
WEIGHTS = {"bm25": 0.35, "vector": 0.25, "anchor_score": 0.15, "scope_score": 0.10, "sector_score": 0.10, "title_score": 0.05}
SATURATION = {"asset": 18, "liability": 18, "income": 22}
DENSE = {"asset": 10, "liability": 10, "income": 12}

_ASSETS = ("valeurs en caisse", "creances sur les etablissements", "creances sur la clientele", "titres de placement", "immobilisations corporelles", "immobilisations incorporelles", "immobilisations financieres", "stocks de marchandises", "autres actifs", "tresorerie actif", "ecart de conversion actif")
_LIABILITIES = ("capital social", "primes liees au capital", "report a nouveau", "dettes envers les etablissements", "depots de la clientele", "titres de creance emis", "provisions pour risques", "autres passifs", "tresorerie passif", "fournisseurs et comptes rattaches", "ecart de conversion passif")
_INCOME = ("chiffre d'affaires", "produits d'exploitation", "charges d'exploitation", "achats consommes", "charges de personnel", "dotations d'exploitation", "produits financiers", "charges financieres", "resultat courant", "resultat non courant", "impots sur les resultats", "resultat net")


@dataclass(frozen=True)
class Vocabulary:
    """Folded phrases. signatures: row labels by (target, scope); anchors: broader ones by target;
    required: groups of parts of labels by target, each of which should be hit; titles: by target."""

    signatures: dict[tuple[str, str], tuple[str, ...]] = field(
        default_factory=lambda: {
            ("asset", "statutory"): (*_ASSETS, "frais preliminaires", "charges a repartir", "actif circulant"),
            ("asset", "consolidated"): (*_ASSETS, "ecart d'acquisition", "droits d'utilisation", "actifs d'impot differe"),
            ("liability", "statutory"): (*_LIABILITIES, "subventions d'investissement", "provisions reglementees", "passif circulant"),
            ("liability", "consolidated"): (*_LIABILITIES, "capitaux propres part du groupe", "interets minoritaires", "passifs d'impot differe"),
            ("income", "statutory"): (*_INCOME, "subventions d'equilibre", "reprises d'exploitation"),
            ("income", "consolidated"): (*_INCOME, "part du groupe", "resultat par action"),
        }
    )
    anchors: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"asset": (*_ASSETS, "total actif"), "liability": (*_LIABILITIES, "total passif"), "income": (*_INCOME, "total des produits")})
    required: dict[str, tuple[tuple[str, ...], ...]] = field(
        default_factory=lambda: {
            "asset": (("creances",), ("immobilisations",), ("stocks", "titres"), ("tresorerie", "caisse")),
            "liability": (("capital",), ("dettes", "depots"), ("provisions",), ("tresorerie", "fournisseurs")),
            "income": (("produits", "chiffre"), ("charges", "achats"), ("financi",), ("resultat",)),
        }
    )
    titles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"asset": ("bilan actif", "actif"), "liability": ("bilan passif", "passif"), "income": ("compte de produits et charges", "compte de resultat", "etat du resultat")})
    scopes: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"consolidated": ("consolide", "ifrs", "part du groupe"), "statutory": ("comptes sociaux", "etats de synthese", "bilan social")})
    marks: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "total_general": ("total general",),
            "summary": ("composantes de l'actif", "composantes du passif", "variation", "comptes de bilan"),
            "in_millions": ("en millions",),
            "formal_statement": ("en milliers de dirhams", "total general"),
            "associates": ("co-entreprises", "entreprises associees"),
            "annex": ("annexe",),
            "off_balance": ("hors bilan",),
            "other_statement": ("tableau des flux", "flux de tresorerie", "capacite d'autofinancement", "etat des derogations", "changements de methodes", "detail des postes"),
            "flows": ("flux",),
        }
    )


DEFAULT = Vocabulary()

#: Phrases that one expression looks for: of more, its generated method is too large for the JVM to compile.
TESTED = 8


def extra_rules(v: Vocabulary) -> dict[str, Rule]:
    """Rules that the scores need beside those of statements."""
    m = v.marks
    return {
        "total_general": Marks(m["total_general"]),
        "management_summary": All((Marks(m["summary"]), Marks(m["in_millions"]))),
        "formal_statement": Marks(m["formal_statement"]),
        "associates": Marks(m["associates"], 1, 1800),
        "annex_head": Marks(m["annex"], 1, 300),
        "off_balance": Marks(m["off_balance"]),
        "other_statement": Marks(m["other_statement"]),
        "flows": Marks(m["flows"]),
        **{f"{t}_title_hit": Marks(v.titles[t]) for t in TARGETS},
        **{f"{s}_words": Marks(v.scopes[s]) for s in SCOPES},
        **{f"{s}_complete": All((Named(f"{s}_header"), Named(f"{s}_total"))) for s in statements.SIDES},
        "opposite_any": Any((Named("asset_main"), Named("liability_main"))),
    }


def page_features(pages: DataFrame, document: str, page: str, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Of pages with folded, loosened, scopes, titles (arrays) and sector: a row without text that has
    all that the scores need, for every target and scope."""
    rows = statements.with_kinds(pages)
    rows = with_rules(rows, extra_rules(vocabulary))
    # Each phrase is looked for once; lists of phrases are masks of what was found.
    words = list(dict.fromkeys(w for table in (vocabulary.signatures, vocabulary.anchors) for own in table.values() for w in own))
    parts = [words[i : i + TESTED] for i in range(0, len(words), TESTED)]
    rows = rows.selectExpr("*", *(f"{' + '.join(f'IF({hit_sql(w)}, {1 << i}L, 0L)' for i, w in enumerate(part))} AS _found{k}" for k, part in enumerate(parts)))
    masks = lambda own: [sum(1 << i for i, w in enumerate(part) if w in own) for part in parts]
    count = lambda own: "(" + " + ".join(f"bit_count(_found{k} & {m}L)" for k, m in enumerate(masks(own)) if m) + ")"
    some = lambda own: " OR ".join(f"(_found{k} & {m}L) <> 0" for k, m in enumerate(masks(own)) if m) or "false"

    def covered(own: tuple[str, ...], target: str) -> str:
        groups = vocabulary.required[target]
        found = " + ".join(f"CAST(({some({w for w in own if any(x in w for x in g)})}) AS INT)" for g in groups)
        return coverage_sql(count(set(own)), f"({found})", len(set(own)), len(groups), SATURATION[target])

    out: dict[str, str] = {}
    for t in TARGETS:
        out[f"{t}_anchor"] = covered(vocabulary.anchors[t], t)
        for s in SCOPES:
            own = vocabulary.signatures[t, s]
            out |= {f"{t}_{s}_n": count(set(own)), f"{t}_{s}_sig": covered(own, t), f"{t}_{s}_cov": f"{count(set(own))} / {float(len(set(own)))}D"}
    flags = [*statements.RULES, *extra_rules(vocabulary)]
    # Kept: neighbours read them twice, and the texts are worked on once.
    rows = kept(rows.select(document, page, "sector", "scopes", "titles", *flags, *(F.expr(c).alias(k) for k, c in out.items())), "features")
    return with_neighbours(rows, document, page, ["asset_main", "liability_main", "asset_complete", "liability_complete", "any_main"])


def requested(features: DataFrame, requests: list[tuple[int, str, str, str]]) -> DataFrame:
    """Every page for every request (query_id, target, scope, sector), with the terms of that request:
    the few requests are an array that is exploded, nothing is shuffled."""
    asked = F.array(*(F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(t).alias("target"), F.lit(s).alias("scope"), F.lit(x).alias("wanted_sector")) for q, t, s, x in requests))
    rows = features.withColumn("_r", F.explode(asked)).select("*", "_r.*").drop("_r")
    return rows.selectExpr("*", *(f"{sql} AS {name}" for name, sql in TERMS.items()))


def _target(pattern: str) -> str:
    return "CASE target " + " ".join(f"WHEN '{t}' THEN {pattern.replace('@', t)}" for t in TARGETS) + " END"


def _side(pattern: str) -> str:
    """By the requested side (@) and the other one (~); false for income."""
    return "CASE target " + " ".join(f"WHEN '{a}' THEN {pattern.replace('@', a).replace('~', b)}" for a, b in (statements.SIDES, statements.SIDES[::-1])) + " ELSE false END"


def _scoped(pattern: str) -> str:
    """By target (@) and scope: ^ stands for the requested scope, ~ for the other."""
    return "CASE " + " ".join(f"WHEN target = '{t}' AND scope = '{s}' THEN {pattern.replace('@', t).replace('^', s).replace('~', o)}" for t in TARGETS for s, o in (SCOPES, SCOPES[::-1])) + " END"


def _scope(pattern: str) -> str:
    return "CASE scope " + " ".join(f"WHEN '{s}' THEN {pattern.replace('^', s).replace('~', o)}" for s, o in (SCOPES, SCOPES[::-1])) + " END"


_LISTED = "array_contains(scopes, '{}')"

#: What conditions speak of, by name.
TERMS: dict[str, str] = {
    "balance_asked": "target <> 'income'",
    "dense": "CASE target " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in DENSE.items()) + " END",
    "raw_anchor": _target("@_anchor"),
    "n_labels": _scoped("@_^_n"),
    "sig": _scoped("@_^_sig"),
    "coverage": _scoped("@_^_cov"),
    "opposite": _scoped("@_~_sig"),
    "own_total": _side("@_total OR (wanted_sector = 'other' AND total_general)"),
    "main": _side("@_main"),
    "complete": _side("@_complete"),
    "other_side": _side("~_header OR ~_total"),
    "beside_other": _side("coalesce(previous_~_main OR previous_~_complete, false) OR coalesce(next_~_main OR next_~_complete, false)"),
    "other_only": _side("~_only"),
    "strong": _target("@_strong_title"),
    "title_hit": _target("@_title_hit"),
    "detected": _target("array_contains(titles, '@')"),
    "scope_listed": _scope(_LISTED.format("^")),
    "other_listed": _scope(_LISTED.format("~")),
    "scope_words": _scope("^_words"),
    "other_words": _scope("~_words"),
    "sure_title": "target <> 'income' OR NOT narrative OR income_table",
    "sector_score": "CASE WHEN sector = wanted_sector THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
}

Branch = tuple[str, str, str]
Step = tuple[Branch, ...]

#: From raw_anchor.
ANCHOR_STEPS: tuple[Step, ...] = (
    (("target = 'asset' AND NOT own_total", "mul", "0.45"),),
    (("target = 'liability' AND NOT own_total", "mul", "0.35"),),
    (("balance_asked AND wanted_sector = 'other' AND management_summary", "mul", "0.15"), ("balance_asked AND wanted_sector = 'other' AND formal_statement", "boost", "0.25")),
    (("balance_asked AND wanted_sector = 'other' AND note_repeat", "mul", "0.25"),),
    (("balance_asked AND wanted_sector = 'other' AND associates", "mul", "0.20"),),
    (("balance_asked AND wanted_sector = 'other' AND annex_head AND own_total", "boost", "0.20"),),
    (("off_balance AND NOT own_total", "add", "-0.35"),),
    (("balance_asked AND other_statement AND NOT own_total", "add", "-0.35"),),
    (("NOT balance_asked AND flows", "add", "-0.60"),),
    (("NOT balance_asked AND wanted_sector = 'bank' AND bank_income", "boost", "0.40"), ("NOT balance_asked AND income_table", "boost", "0.25"), ("NOT balance_asked AND narrative", "mul", "0.30")),
    (("NOT balance_asked AND wanted_sector = 'bank' AND foreign_page", "mul", "0.25"),),
    (("NOT balance_asked AND cash_flow AND NOT income_title", "mul", "0.05"),),
    (("NOT balance_asked AND balance AND NOT income_title", "mul", "0.10"),),
    (("true", "clamp", ""),),
)
#: The page's labels support its anchors.
SUPPORT_STEPS: tuple[Step, ...] = ((("n_labels > 0", "floor", "0.55 * anchor_score + 0.45 * sig"),),)
#: From 0.25.
SCOPE_STEPS: tuple[Step, ...] = (
    (
        ("scope = 'consolidated' AND consolidated_page", "set", "0.95"),
        ("scope = 'statutory' AND statutory_page AND NOT strong_consolidated", "set", "0.90"),
        ("scope_listed", "set", "1.0"),
        ("scope_words", "set", "0.75"),
    ),
    (("other_listed AND NOT scope_listed AND NOT (scope = 'statutory' AND statutory_page)", "set", "0.0"), ("other_words AND NOT scope_words", "cap", "0.15")),
    (("scope = 'consolidated' AND strong_statutory", "cap", "CASE WHEN strong_consolidated THEN 0.20 ELSE 0.05 END"),),
    (("scope = 'consolidated' AND statutory_page AND NOT consolidated_page", "cap", "0.02"),),
    (("scope = 'statutory' AND strong_consolidated AND NOT strong_statutory", "cap", "0.05"),),
    (("scope = 'statutory' AND consolidated_page AND NOT statutory_page", "cap", "0.02"),),
    (("true", "clamp", ""),),
)
#: From 0.
TITLE_STEPS: tuple[Step, ...] = (
    (
        ("NOT balance_asked AND foreign_page", "set", "CASE WHEN title_hit THEN 0.10 ELSE 0.0 END"),
        ("balance_asked AND strong AND main", "set", "1.0"),
        ("NOT balance_asked AND strong AND sure_title AND bank_income", "set", "1.0"),
        ("strong AND sure_title AND note_repeat", "set", "0.45"),
        ("detected AND strong AND sure_title", "set", "1.0"),
        ("detected", "set", "0.35"),
        ("strong AND sure_title", "set", "0.9"),
        ("title_hit", "set", "0.25"),
    ),
)
#: From 0: where the page lies among the statements.
LAYOUT_STEPS: tuple[Step, ...] = (
    (("balance_asked AND breakdown", "set", "0.0"), ("balance_asked AND main", "set", "1.0"), ("balance_asked AND complete AND other_side", "set", "0.95"), ("balance_asked AND complete AND beside_other", "set", "0.85")),
    (
        ("NOT balance_asked AND income_title AND (income_table OR bank_income)", "set", "1.0"),
        ("NOT balance_asked AND any_main", "set", "0.95"),
        ("NOT balance_asked AND coalesce(next_any_main, false)", "set", "0.90"),
        ("NOT balance_asked AND coalesce(previous_any_main, false)", "set", "0.75"),
    ),
)
#: How well the labels of the requested scope cover the page. No step but the first where none is hit.
DOMINANCE_STEPS: tuple[Step, ...] = (
    (("n_labels = 0 AND title_score >= 0.50 AND sig < 0.10", "mul", "0.65"),),
    (
        ("n_labels >= dense AND coverage >= 0.80", "floor", "0.82 + 0.16 * coverage"),
        ("n_labels >= dense AND coverage >= 0.70", "floor", "0.72 + 0.18 * coverage"),
        ("n_labels >= dense AND coverage >= 0.60", "floor", "0.58 + 0.20 * coverage"),
        ("n_labels BETWEEN 1 AND 4 AND sig < 0.25", "mul", "0.55"),
    ),
    (
        ("n_labels > 0 AND coverage < 0.50", "mulcap", "0.72, 0.48"),
        ("n_labels > 0 AND coverage < 0.60", "mulcap", "0.80, 0.58"),
        ("n_labels > 0 AND coverage < 0.70 AND title_score < 0.50", "cap", "0.72"),
    ),
    (("n_labels > 0 AND opposite > sig + 0.12", "mul", "0.40"),),
    (("n_labels > 0 AND title_score >= 0.70 AND sig < 0.18 AND n_labels <= 5", "mul", "0.35"),),
    (("n_labels > 0 AND scope_score <= 0.20 AND sig >= 0.70 AND coverage >= 0.70 AND n_labels >= dense", "floor", "0.70 + 0.22 * sig"),),
    (("n_labels > 0", "clamp", ""),),
)
#: The first that fits: another statement than the one asked for.
WRONG_STEPS: tuple[Step, ...] = (
    (
        ("NOT balance_asked AND cash_flow AND NOT income_title", "mul", "0.12"),
        ("NOT balance_asked AND balance AND NOT income_title", "mul", "0.20"),
        ("balance_asked AND cash_flow AND NOT strong", "mul", "0.15"),
        ("balance_asked AND income_strong_title AND NOT strong AND coverage < 0.70 AND sig < 0.78 AND layout < 0.75", "mul", "0.20"),
        ("balance_asked AND other_only", "mul", "0.20"),
    ),
)
#: From the weighted sum.
BLEND_STEPS: tuple[Step, ...] = (
    (("scope_score <= 0.05", "mul", "0.45"),),
    (("NOT balance_asked AND cash_flow AND NOT income_title", "mul", "0.12"),),
    (("NOT balance_asked AND foreign_page", "mul", "0.22"),),
    (("NOT balance_asked AND note_detail AND title_score < 0.5 AND NOT income_title", "mul", "0.25"),),
    (("NOT balance_asked AND narrative AND title_score < 0.5", "mul", "0.35"),),
    (("NOT balance_asked AND layout >= 0.75 AND (title_score >= 0.5 OR anchor_score >= 0.35)", "boost", "0.10 * layout"),),
    (("balance_asked AND note_detail AND title_score < 0.5", "mul", "0.35"),),
    (("balance_asked AND currency_page", "mul", "0.07"),),
    (
        ("balance_asked AND main", "boost", "0.18 + CASE WHEN sig >= 0.55 THEN 0.14 ELSE 0.0 END + CASE WHEN layout >= 0.75 THEN 0.08 ELSE 0.0 END"),
        ("balance_asked AND segment", "mul", "0.12"),
        ("balance_asked AND policy", "mul", "0.10"),
        ("balance_asked AND breakdown", "mul", "0.18"),
        ("balance_asked AND note_detail", "mul", "0.16"),
        ("balance_asked AND anchor_score < 0.12 AND title_score < 0.50", "mul", "0.35"),
    ),
    (("balance_asked AND NOT main AND sig < 0.20 AND anchor_score < 0.20 AND title_score >= 0.50", "mul", "0.18"),),
    (("balance_asked AND layout >= 0.75", "boost", "0.12 * layout"),),
    *DOMINANCE_STEPS,
    (("opposite > sig + 0.18", "mul", "0.35"),),
    (("balance_asked AND NOT main AND (note_detail OR policy OR breakdown)", "mul", "0.28"), ("balance_asked AND NOT main AND layout <= 0 AND sig < 0.70", "mul", "0.55")),
    *WRONG_STEPS,
    (("excluded", "mul", "0.02"),),
)


def effect(name: str, kind: str, amount: str) -> str:
    """The SQL of a branch's new value of column `name`."""
    if kind == "mulcap":
        by, top = amount.split(", ")
        return f"least({name} * {by}, {top})"
    return {
        "mul": f"{name} * ({amount})",
        "boost": f"least({name} + ({amount}), 1.0)",
        "add": f"{name} + ({amount})",
        "floor": f"greatest({name}, {amount})",
        "cap": f"least({name}, {amount})",
        "set": amount,
        "clamp": f"least(greatest({name}, 0.0), 1.0)",
    }[kind]


def step_sql(name: str, step: Step) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {when} THEN {effect(name, kind, amount)}" for when, kind, amount in step) + f" ELSE {name} END AS DOUBLE)"


def bounded_sql(value: str, step: Step) -> str:
    """The same as step_sql() for a step whose conditions and amounts don't speak of the value: a factor, a
    summand, a top and a floor, each by the first condition that holds, so that the value stands in it once and
    a chain of steps is one expression."""
    found: dict[str, list[tuple[str, str | None]]] = {"by": [], "plus": [], "top": [], "floor": []}
    for when, kind, amount in step:
        by, top = amount.split(", ") if kind == "mulcap" else (amount, amount)
        own = {
            "mul": {"by": by}, "mulcap": {"by": by, "top": top}, "boost": {"plus": amount, "top": "1.0"}, "add": {"plus": amount}, "floor": {"floor": amount}, "cap": {"top": amount},
            "set": {"by": "0.0", "plus": amount}, "clamp": {"top": "1.0", "floor": "0.0"},
        }[kind]
        for part, branches in found.items():
            branches.append((when, own.get(part)))

    def case(part: str, neutral: str) -> str | None:
        branches = found[part]
        while branches and branches[-1][1] is None:  # what is neutral to the end needn't be told
            branches = branches[:-1]
        return "CASE " + " ".join(f"WHEN {when} THEN {amount or neutral}" for when, amount in branches) + f" ELSE {neutral} END" if branches else None

    if by := case("by", "1.0D"):
        value = f"{value} * ({by})"
    if plus := case("plus", "0.0D"):
        value = f"{value} + ({plus})"
    if top := case("top", "NULL"):
        value = f"least({value}, CAST({top} AS DOUBLE))"  # a null is no top
    if floor := case("floor", "NULL"):
        value = f"greatest({value}, CAST({floor} AS DOUBLE))"
    return f"CAST({value} AS DOUBLE)"


def chain(rows: DataFrame, name: str, start: str, steps: tuple[Step, ...]) -> DataFrame:
    """Adds column `name`: the value of start after all steps, in order. Steps are put into one another as far as
    none of their conditions and amounts speaks of the value itself; one that does reads it as a column."""
    value = f"CAST({start} AS DOUBLE)"
    for step in steps:
        if any(re.search(rf"\b{name}\b", f"{when} {amount}") for when, _, amount in step):
            rows = rows.withColumn(name, F.expr(value)).withColumn(name, F.expr(step_sql(name, step)))
            value = name
        else:
            value = bounded_sql(value, step)
    return rows.withColumn(name, F.expr(value))


#: Chains in their order: name, start, steps.
CHAINS: tuple[tuple[str, str, tuple[Step, ...]], ...] = (
    ("anchor_score", "raw_anchor", ANCHOR_STEPS + SUPPORT_STEPS),
    ("scope_score", "0.25", SCOPE_STEPS),
    ("title_score", "0.0", TITLE_STEPS),
    ("layout", "0.0", LAYOUT_STEPS),
    ("score", " + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()), BLEND_STEPS),
)


def scored(rows: DataFrame) -> DataFrame:
    """Adds anchor_score, scope_score, title_score, layout and score to requested pages that have bm25,
    vector (0 to 1, 0 where there is none) and excluded."""
    for name, start, steps in CHAINS:
        rows = chain(rows, name, start, steps)
    return rows


def breakdown(rows: DataFrame) -> Column:
    """The terms of a score under their report names; what speaks against the page is negative."""
    names = {"bm25": "bm25", "vector": "vector", "anchor": "anchor_score", "scope": "scope_score", "title": "title_score", "signature": "sig"}
    return F.struct(*(F.round(c, 6).alias(k) for k, c in names.items()), F.round(F.lit(0.0) - F.col("opposite"), 6).alias("negative_penalty"), F.round("score", 6).alias("final_score"))


#: What the branches of steps say of a page, in the steps' order; None says nothing.
SCOPE_WHY = (
    ("scope_formal:consolidated", "scope_formal:statutory", "scope:^", "scope_signal:^"), ("scope_penalty:~", "scope_signal_penalty:~"), ("scope_strong_penalty:statutory",),
    ("scope_strong_penalty:formal_statutory",), ("scope_strong_penalty:consolidated",), ("scope_strong_penalty:formal_consolidated",), (None,),
)
TITLE_WHY = (("title_foreign", "title_strong:@", "title_strong:@", "title_note_repeat:@", "title:@", "title_weak:@", "title_strong:@", "title_hit"),)
WRONG_WHY = (("wrong:cash_flow_page", "wrong:balance_page", "wrong:cash_flow_page", "wrong:income_title", "wrong:other_side_only"),)
#: Numbers that are told of each page; of income pages the place among statements has another name.
TOLD = {"signature_score": "anchor_score", "scope_signature_score": "sig", "scope_signature_hits": "n_labels", "scope_signature_coverage": "coverage", "opposite_scope_signature_score": "opposite", "layout_score": "layout"}


def why_sql(steps: tuple[Step, ...], why: tuple[tuple[str | None, ...], ...], text: str) -> list[str]:
    """Of each step the words of the first branch that holds: @, ^ and ~ stand for target, scope and other scope.
    text: SQL of a string with these replaced."""
    return ["CASE " + " ".join(f"WHEN {when} THEN {'NULL' if words is None else text.replace('?', words)}" for (when, _, _), words in zip(step, own)) + " END" for step, own in zip(steps, why, strict=True)]


def reasons(text: str) -> list[str]:
    """SQL of what is told of a page besides numbers, each null where it doesn't hold."""
    return ["CASE WHEN excluded THEN 'penalty:excluded_page' END", *why_sql(SCOPE_STEPS, SCOPE_WHY, text), *why_sql(TITLE_STEPS, TITLE_WHY, text), *why_sql(WRONG_STEPS, WRONG_WHY, text)]


REASON_TEXT = "replace(replace(replace('?', '@', target), '^', scope), '~', CASE scope WHEN 'consolidated' THEN 'statutory' ELSE 'consolidated' END)"


def evidence(rows: DataFrame, name: str = "evidence") -> DataFrame:
    """Adds why a page has its score, as short texts in a fixed order: scope, title and penalties as the steps
    that were taken say them, then numbers, then the sector where it is the wanted one."""
    told = [f"concat('{k}:', {'CAST(n_labels AS STRING)' if c == 'n_labels' else f"format_string('%.3f', round({c}, 3))"})" for k, c in TOLD.items()]
    parts = [*reasons(REASON_TEXT), *told, "CASE WHEN sector_score > 0 THEN concat('sector:', sector) END"]
    return rows.withColumn(name, F.expr(f"array_compact(array({', '.join(parts)}))"))


def retrieved(rows: DataFrame, group: list[str], page: str, k: int = 8, gap: float = 0.045) -> DataFrame:
    """The k best pages of each group of scored() rows with rank and evidence: close first pages are put in the
    order of their structure, the first one tells its margin; pages that are formally of the other scope only
    are dropped, unless a group would lose all."""
    best = top_k(evidence(rows).withColumn("_s", F.round("score", 9)), group, "_s", [page], k)
    key = F.round(structural_key(F.col("sig"), F.col("anchor_score"), F.col("title_score"), F.col("scope_score")), 9)
    w = Window.partitionBy(*group)
    best = best.withColumn("_before", F.col("rank")).withColumn("_n", F.count("*").over(w)).withColumn("_gap", F.max(F.when(F.col("rank") == 1, F.col("_s"))).over(w) - F.max(F.when(F.col("rank") == 2, F.col("_s"))).over(w))
    best = tiebreak(best, group, "_s", [key, F.col("sig"), F.col("anchor_score"), F.col("title_score")], page, gap)
    first = F.col("rank") == 1
    moved = F.when(first & (F.col("_before") > 1), "retrieval_tiebreak:scope_signature_and_anchors")
    margin = F.when(first & (F.col("_n") == 1), "retrieval_margin:single_candidate").when(first, F.concat(F.lit("retrieval_margin:"), F.format_string("%.4f", F.round("_gap", 4))))
    told = best.withColumn("evidence", F.concat("evidence", F.array_compact(F.array(moved, margin))))
    return same_scope_or_all(told, group).drop("_s", "_before", "_n", "_gap")


def same_scope_or_all(rows: DataFrame, group: list[str]) -> DataFrame:
    """Drops pages that are formally of the other scope only, unless a group would lose all."""
    other = F.expr("CASE scope WHEN 'consolidated' THEN statutory_page AND NOT consolidated_page ELSE consolidated_page AND NOT statutory_page END")
    return keep_or_all(rows, group, ~other)
