"""What kind of page a page of a financial report is: rules on its folded text.

The rules' shapes (how many phrases, within which window, what excludes what) are those of statement
pages in annual and half-year reports; the phrases are this engine's own. Another vocabulary can be
given to rules() as a table of phrases by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagemill.operators.marks import All, Any, Marks, Named, Not, Pattern, Rule, with_rules

SIDES = ("asset", "liability")

# The word for each side, and how titles of statements are written with it.
SIDE_WORD = {"asset": "actif", "liability": "passif"}
DATED_TITLE = ("{word} 30/06", "{word} 31/12", "{word} notes")
DATED_WINDOW = {"asset": 3200, "liability": 7000}

#: Phrases by name, folded.
PHRASES: dict[str, tuple[str, ...]] = {
    "asset_title": ("bilan actif", "actif du bilan", "bilan - actif"),
    "asset_title_late": ("actif immobilise", "emplois du bilan"),
    "asset_header": ("actif", "emplois"),
    "asset_total": ("total actif", "total de l'actif", "total des actifs"),
    "asset_rows": ("valeurs en caisse", "prets et creances", "immobilisations corporelles", "immobilisations incorporelles", "titres de participation", "stocks", "autres actifs", "tresorerie actif"),
    "liability_title": ("bilan passif", "passif du bilan", "bilan - passif"),
    "liability_title_late": ("capitaux propres et passif", "ressources du bilan"),
    "liability_header": ("passif", "ressources"),
    "liability_total": ("total passif", "total du passif", "total des passifs"),
    "liability_rows": ("capital social", "reserves", "dettes envers", "depots de la clientele", "provisions pour risques", "resultat net de l'exercice", "autres passifs", "tresorerie passif"),
    "income_title": ("compte de produits et charges", "compte de resultat", "etat du resultat", "comptes de resultats", "produits et charges d'exploitation"),
    "income_title_late": ("resultat d'exploitation", "resultat courant"),
    "income_rows": ("chiffre d'affaires", "produits d'exploitation", "charges d'exploitation", "produits financiers", "charges financieres", "impots sur les resultats", "resultat net", "produit net bancaire", "cout du risque", "primes acquises"),
    "income_sure": ("total des produits", "total des charges", "resultat avant impot", "resultat non courant", "marge brute", "valeur ajoutee", "excedent brut", "solde de gestion", "marge d'interet", "dotations d'exploitation", "reprises d'exploitation"),
    "main_title": ("bilan", "situation financiere", "etat de la situation"),
    "currency": ("en milliers", "en millions", "mad", "dirhams", "31 decembre", "30 juin", "exercice clos"),
    "breakdown_by_currency": ("ventilation", "devises"),
    "note_repeat": ("note annexe", "notes annexes", "suite de la note", "voir note", "renvoi a la note", "note n", "annexe n"),
    "segment": ("information sectorielle", "secteur operationnel", "secteurs d'activite", "par secteur", "par pole", "par zone geographique", "contribution des secteurs", "resultat sectoriel", "actifs sectoriels", "passifs sectoriels", "intersecteur"),
    "segment_together": ("banque de detail", "banque d'affaires", "total secteurs"),
    "policy": ("principes comptables", "methodes comptables", "regles d'evaluation", "base de preparation", "normes applicables", "est comptabilise", "sont comptabilises", "sont evalues", "a la juste valeur", "cout amorti", "duree d'utilite", "test de depreciation", "le groupe applique", "jugements et estimations"),
    "breakdown": ("duree residuelle", "jusqu'a 3 mois", "de 3 mois a 1 an", "plus de 5 ans", "garanties recues", "garanties donnees", "par echeance", "suretes reelles", "engagements de financement"),
    "formal_bank_income": ("interets et produits assimiles", "interets et charges assimilees", "marge d'interets", "commissions percues", "commissions servies", "produit net bancaire", "charges generales", "resultat brut d'exploitation", "cout du risque"),
    "local_currency": ("dirhams", "mad", "kdh", "mdh"),
    "foreign": ("filiale etrangere", "succursale a l'etranger", "en milliers d'euros", "en euros", "en dollars", "franc cfa", "dinar", "taux de change", "ecart de conversion", "monnaie fonctionnelle", "norme locale", "autorite etrangere", "pays d'implantation"),
    "narrative": ("en progression de", "en hausse de", "en baisse de", "s'est etabli", "s'eleve a", "au titre de l'exercice", "commentaires", "faits marquants", "perspectives", "le management", "la direction", "communique", "nous avons", "croissance de", "tire par"),
    "cash_flow": ("flux de tresorerie", "tableau de financement", "variation de tresorerie", "capacite d'autofinancement", "flux net", "tresorerie d'ouverture", "tresorerie de cloture", "activites d'investissement"),
    "note_detail": ("detail des", "tableau des", "variation de l'exercice", "montant brut", "amortissements cumules", "dotation de l'exercice", "solde d'ouverture", "solde de cloture", "augmentation", "diminution", "etat des"),
    "consolidated": ("comptes consolides", "bilan consolide", "etats financiers consolides", "groupe consolide"),
    "consolidated_formal": ("bilan consolide", "compte de resultat consolide", "etat consolide", "situation financiere consolidee", "comptes consolides ifrs", "etats consolides", "resultat consolide"),
    "consolidated_compact": ("ifrs", "part du groupe", "interets minoritaires"),
    "statutory": ("comptes sociaux", "etats de synthese", "bilan social", "comptes individuels", "comptes annuels", "modele normal", "cgnc", "plan comptable", "liasse"),
    "statutory_compact": ("actif", "brut", "amortissements", "net", "exercice"),
}


def strong_title(side: str, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Rule:
    """Whether a page is titled as a side's statement: it is that statement, or has one of the ways to write its title
    in the place where it would stand. Of a page that breaks balances down by currency only the first counts."""
    word, main = SIDE_WORD[side], Named(f"{side}_main")
    titles = (
        Marks(phrases[f"{side}_title"], 1, 900), Marks(phrases[f"{side}_title_late"], 1, 1800),
        Pattern(rf"\bbilan\s+{word}\b"), Pattern(r"\bbilan\s+social\b", 3500), Pattern(rf"\b{word}\b", 900),
        Marks((f"{word} ifrs", f"{word} consolide"), 1, 3000), Marks((f"bilan ({word})",)), Marks((f"bilan {word}",), 1, 1200),
        All((Marks(("en milliers de mad",), 1, 1800), Pattern(rf"(^| ){word}( |$)", 1800), Marks(("total general",)))),
    )
    return Any((main, All((Not(Named("currency_page")), Any(titles)))))


def rules(phrases: dict[str, tuple[str, ...]] = PHRASES) -> dict[str, Rule]:
    """Rules by name; of sides: <side>_<rule>."""
    p = phrases
    out: dict[str, Rule] = {
        "currency_page": All(tuple(Marks((x,), 1, 4500) for x in p["breakdown_by_currency"])),
        "note_repeat": Marks(p["note_repeat"], 1, 1400),
        "cash_flow": Marks(p["cash_flow"], 1, 2600),
        "narrative": Marks(p["narrative"], 1, 2600),
        "foreign_page": Marks(p["foreign"], 2, 3500),
        "note_detail": Marks(p["note_detail"], 2, 3200),
        "policy": Marks(p["policy"], 2, 3200),
        "segment": Any((Marks(p["segment"], 2, 4200), All(tuple(Marks((x,), 1, 4200) for x in p["segment_together"])))),
        "breakdown": All((Not(Marks(p["asset_title"] + p["liability_title"], 1, 700)), Marks(p["breakdown"], 2, 3600))),
        "income_title": Marks(p["income_title"]),
        "income_strong_title": Any((Marks(p["income_title"], 1, 500), Marks(p["income_title_late"], 2, 7000))),
        "income_table": Any((Marks(p["income_rows"], 4, 2500), Marks(p["income_sure"], 1, 2500))),
        "bank_income": All((Marks(p["income_title"], 1, 7000), Marks(p["local_currency"], 1, 7000), Marks(p["formal_bank_income"], 3))),
        "statutory_page": All((Not(Marks(p["consolidated"])), Any((Marks(p["statutory"], 1, 2500), All(tuple(Marks((x,), 1, 2500) for x in p["statutory_compact"])))))),
        "consolidated_page": Any((Marks(p["consolidated_formal"], 1, 2600), All(tuple(Marks((x,), 1, 2600) for x in p["consolidated_compact"])))),
        "strong_consolidated": Marks(p["consolidated"], 1, 2600),
        "strong_statutory": Marks(p["statutory"], 1, 2600),
    }
    for side in SIDES:
        out |= {
            f"{side}_strong_title": strong_title(side, p),
            f"{side}_header": Marks(p[f"{side}_header"], 1, 7000),
            f"{side}_total": Marks(p[f"{side}_total"]),
            f"{side}_balance": Any((Marks(p[f"{side}_title"], 1, 2500), All((Named(f"{side}_total"), Marks(p[f"{side}_rows"], 2))))),
            f"{side}_main": All(
                (
                    Not(Named("segment")), Not(Named("policy")), Not(Named("breakdown")),
                    Any((Marks(p["main_title"], 1, 7000), Marks(tuple(x.format(word=SIDE_WORD[side]) for x in DATED_TITLE), 1, DATED_WINDOW[side]))),
                    Marks(p[f"{side}_header"], 1, 7000), Named(f"{side}_total"),
                    Marks(p["currency"], 1, 3200), Marks(p[f"{side}_rows"], 3),
                )
            ),
        }
    for side, other in (SIDES, SIDES[::-1]):
        out[f"{side}_only"] = All((Marks(p[f"{side}_header"], 1, 2200), Not(Marks(p[f"{other}_header"], 1, 7000)), Named(f"{side}_total")))
    out["balance"] = Any((Named("asset_balance"), Named("liability_balance")))
    out["any_main"] = Any((Named("asset_main"), Named("liability_main")))
    return out


RULES = rules()


# What a kept table's page says where the table is not to be used again.
CONTEXT = {
    "alternate": ("bilan arreda", "compte de produits et charges arreda", "etats de synthese arreda"),
    "asset_total": ("total actif", "total de l actif"),
    "liability_total": ("total passif", "total du passif"),
    "other_statement": ("tableau des flux de tresorerie", "flux de tresorerie nets", "capacite d autofinancement", "etat des derogations", "etat des changements de methodes", "detail des postes", "details des postes"),
    "false_header": ("passif financier", "passifs financiers", "provisions du passif", "passifs d impots", "passifs d'impots"),
    "summary": ("l actif et ses composantes", "le passif et ses composantes", "variation 24 23", "comptes de bilan"),
    "in_millions": ("en millions",),
    "formal": ("en milliers de mad", "total general i ii iii"),
    "social": ("comptes sociaux ocp sa", "comptes sociaux", "etats financiers sociaux", "etats de synthese sociaux", "bilan social"),
    "consolidated": ("comptes consolides normes ifrs", "comptes consolides", "etats financiers consolides", "situation financiere consolidee"),
}
FALSE_HEADER_ABOVE = 260.0


def page_context(c: dict[str, tuple[str, ...]] = CONTEXT) -> dict[str, Rule]:
    """What cached_vetoes() needs to know of a page, by name."""
    return {
        "says_alternate": Marks(c["alternate"]), "says_asset_total": Marks(c["asset_total"]), "says_liability_total": Marks(c["liability_total"]), "says_other_statement": Marks(c["other_statement"]),
        "says_false_header": All((Marks(c["false_header"]), Marks(c["liability_total"]))), "says_summary": All((Marks(c["summary"]), Marks(c["in_millions"]), Not(Marks(c["formal"])))),
        "says_social": Marks(c["social"]), "says_consolidated": Marks(c["consolidated"]),
    }


#: Vetoes of a kept result by name: its request (target, scope, sector), box, evidence and page. SQL of both engines but for `header`.
VETOES = {
    "alternate_statement": "says_alternate",
    "wrong_balance": "(target = 'asset' AND NOT says_asset_total OR target = 'liability' AND NOT says_liability_total) AND says_other_statement",
    "bad_line_header": f"target = 'liability' AND sector = 'bank' AND (box_size <> 4 OR header AND top < {FALSE_HEADER_ABOVE} AND says_false_header)",
    "management_summary": "target IN ('asset', 'liability') AND says_summary",
    "wrong_scope": "(scope = 'consolidated' AND says_social OR scope = 'statutory' AND says_consolidated AND NOT says_social)",
}


def cached_vetoes(results: DataFrame, folded: str = "folded") -> DataFrame:
    """Adds vetoes: why a kept result (target, scope, sector, bbox, evidence, and its page's folded text) is not to be
    used again, in the order of VETOES; none where there is no text."""
    rows = with_rules(results, page_context(), folded)
    rows = rows.selectExpr("*", "coalesce(size(bbox), 0) AS box_size", "coalesce(bbox[1], 0D) AS top", "exists(coalesce(evidence, array()), e -> contains(lower(e), 'line_header')) AS header")
    told = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in VETOES.items())
    rows = rows.selectExpr("*", f"CASE WHEN {folded} = '' THEN array() ELSE array_compact(array({told})) END AS vetoes")
    return rows.drop(*page_context(), "box_size", "top", "header")


def context_rules(phrases: dict[str, tuple[str, ...]] = PHRASES) -> dict[str, Rule]:
    """Why a kept table is not to be used again, from its page's text; after rules()."""
    p = phrases
    return {
        "alternate_statement": All((Marks(p["cash_flow"], 1, 1400), Not(Named("any_main")))),
        "wrong_balance": All((Any((Named("segment"), Named("policy"), Named("breakdown"), Named("note_detail"))), Not(Named("any_main")))),
        "bad_header": All((Marks(p["main_title"], 1, 700), Not(Any((Named("asset_total"), Named("liability_total")))))),
        "other_scope_than_consolidated": All((Named("statutory_page"), Not(Named("consolidated_page")))),
        "other_scope_than_statutory": All((Named("consolidated_page"), Not(Named("statutory_page")))),
    }


def with_kinds(pages: DataFrame, folded: str = "folded", phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """Adds a boolean column for each rule to pages with a folded text."""
    return with_rules(pages, RULES if phrases is PHRASES else rules(phrases), folded)
