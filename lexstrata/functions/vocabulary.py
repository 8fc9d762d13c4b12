"""Closed vocabularies as data. All values here are fixed values of the data model; operators take them as parameters."""

from __future__ import annotations

LEVELS = ["razdel", "glava", "paragraph", "statya", "chast", "punkt", "podpunkt"]
LEVEL_ALIASES = {"Razdel": "razdel", "Glava": "glava", "Paragraph": "paragraph", "Statya": "statya", "Chast": "chast", "Punkt": "punkt", "Podpunkt": "podpunkt"}
MARKER_PREFIXES = {"razdel": ["Раздел", "РАЗДЕЛ", "раздел"], "glava": ["Глава", "ГЛАВА", "глава"], "statya": ["Статья", "СТАТЬЯ", "статья"], "paragraph": ["§"]}
NODE_KINDS = ["Work", "Expression", "Manifestation", "ComponentConcept", "AmendingAct", "MembershipEdge", "StructuralIndustrialEvent", "ForceStatusEvent", "DocumentGroupRef"]
EDGE_KINDS = ["expression_of", "manifestation_of", "component_in_expression", "membership_parent", "industrial_op_subject", "industrial_op_target", "force_status_of", "prov_amending_act", "parsed_as"]
FORBIDDEN_KINDS = ["ApplicableDecision", "PracticeRulingAsForce", "RiskScoreAsStatus", "ProfileCodeAsClock", "NormRuleAsAuthority", "NormativeBlob", "DocumentProfileAsAuthority", "ProfileBindingAsForce", "DocumentProfileAsClock"]
CROSS_ACT_KINDS = ["amends", "implements", "specifies", "conflicts_with", "cites", "refers_to"]
FSM_EDGES = [
    ("O0", "O1"), ("O1", "O2"), ("O2", "O2_writeset"), ("O2_writeset", "O2_fold"), ("O2_fold", "O2_expression_presence"), ("O2_expression_presence", "O2_decode_lift"),
    ("O2_decode_lift", "O2_catalog_kinds"), ("O2_catalog_kinds", "O2_catalog_coverage"), ("O2_catalog_coverage", "O2_composition_lift"), ("O2_composition_lift", "O2_decode_prefixes"),
    ("O2_decode_prefixes", "O2_calendar_ordinal"), ("O2_calendar_ordinal", "O3"), ("O3", "O4"), ("O4", "O5"), ("O5", "O6_closed_bounded"), ("O5", "O6_closed_validated"),
]
#: (kind, needle, confidence), first match wins.
LINK_RULES = [
    ("amends", "внесении изменений", 0.9), ("amends", "внесении изменения", 0.9), ("amends", "внести изменения", 0.85), ("amends", "в ред.", 0.9), ("amends", "изменениями", 0.85),
    ("amends", "дополнен", 0.8), ("amends", "признать утратившим", 0.85), ("cites", "согласно", 0.6), ("cites", "в соответствии с", 0.6), ("cites", "предусмотренном", 0.55),
    ("cites", "на основании", 0.55), ("implements", "в порядке", 0.5), ("implements", "установленном", 0.5), ("specifies", "перечень", 0.4), ("specifies", "требования", 0.4),
]
#: (name, kind, confidence, match, needles, needles of one signal)
LINK_TEMPLATES = [
    ("amends_v_red", "amends", 0.9, "all", ["ФЗ"], ["в ред.", "в редакции", "редакции"]),
    ("amends_changes", "amends", 0.85, "any", ["изменениями", "внесении изменений", "внесении изменения", "дополнен", "признать утратившим"], []),
    ("cites_according", "cites", 0.7, "any", ["в соответствии с", "согласно", "предусмотренном", "на основании", "руководствуясь"], []),
    ("implements_order", "implements", 0.5, "any", ["в порядке", "установленном", "во исполнение"], []),
    ("specifies_list", "specifies", 0.4, "any", ["перечень", "требования", "классификаци"], []),
]
#: (name, path needles, boost), first match wins; the last is the default.
PROFILES = [
    ("federal_law", ["federalnyi-zakon", "law_"], 1.0), ("government_act", ["postanovlenie-pravitelstva", "rasporyazhenie-pravitelstva", "resolution_", "directive_"], 0.9),
    ("departmental_act", ["prikaz-", "order_", "instruktsiya"], 0.85), ("court_decision", ["postanovlenie-arbitrazhnogo", "opredelenie", "decision_"], 0.8), ("code", ["kodeks"], 1.0), ("default", [], 0.7),
]
#: (group, field, needle, rank), the lowest rank wins.
GROUP_NEEDLES = [
    ("federal_law@v1", "path", "federalnyi-zakon", 10), ("federal_law@v1", "path", "law_", 20), ("federal_law@v1", "kind", "law", 30), ("federal_law@v1", "type", "federal", 30),
    ("code", "path", "kodeks", 10), ("code", "kind", "code", 20), ("government_resolution", "path", "postanovlenie-pravitelstva", 10), ("government_resolution", "path", "rasporyazhenie-pravitelstva", 10),
    ("government_resolution", "path", "pp_", 15), ("government_resolution", "kind", "resolution", 20), ("departmental_order", "path", "prikaz-", 10), ("departmental_order", "path", "prikaz", 20),
    ("departmental_order", "kind", "order", 20), ("departmental_order", "type", "order", 20), ("court_practice", "path", "reshenie-fas", 10), ("court_practice", "path", "opredelenie-", 10),
    ("court_practice", "path", "postanovlenie-plenuma", 10), ("court_practice", "kind", "fas", 20), ("court_practice", "kind", "court", 20), ("court_practice", "kind", "decision", 25),
    ("court_practice", "kind", "prescription", 25), ("court_practice", "kind", "determination", 25),
]
ROLE_NEEDLES = [
    ("C2hint_change_overview", "path", "obzor-izmenenii", 10), ("C2hint_change_overview", "title", "Обзор изменений", 10), ("C2_edition_oracle", "path", "red-ot-", 20), ("C2_edition_oracle", "path", "edition-", 20),
    ("C2_edition_oracle", "title", "ред. от", 20), ("C1_amending_act", "title", "внести в", 15), ("C1_amending_act", "title", "внесении изменений", 15), ("C3_alien_work", "path", "reshenie-fas", 5),
    ("C3_alien_work", "path", "postanovlenie-pravitelstva", 5), ("C3_alien_work", "path", "prikaz-", 5), ("C3_alien_work", "path", "opredelenie-", 5),
]
ARTICLE_FORMS = "статья статьи статье статью статей статьёй статьей статьями статьях".split()
POINT_FORMS = "пункт пункта пункту пунктом пункте пункты пунктов пунктам пунктами пунктах".split()
#: Morphology classes by word; the genitive plural of the article is a reference form, but no marker form.
MARKER_WORDS = {
    "statya": [w for w in ARTICLE_FORMS if w != "статей"],
    "punkt": POINT_FORMS,
    "obyazan": "обязан обязана обязано обязаны".split(),
    "vprave": ["вправе"],
    "zapret": "запрещается запрещен запрещён запрещена запрещено запрещены".split(),
}
DEONTIC = {"obyazan": "obligation", "vprave": "permission", "zapret": "prohibition"}
PHRASE_VERBS = {"enters_into_force": "вступает вступил вступают".split(), "loses_force": "утрачивает утратил утрачивают".split()}
UNKNOWN_FORMS = {
    "temporal": "вступала вступало вступавший вступающего вступающему утрачивал утрачивавшая утрачивавший утрачивающего утрата".split(),
    "deontic": "нельзя недопустимо запретить запрещение запрещающий запрет".split(),
    "hierarchy": "подпункт подпункта подпункту подпунктом подпункте подпункты подпунктов подпунктам подпунктами подпунктах часть части частью частей частям частями частях параграф параграфа параграфу параграфом параграфе параграфы параграфов абзац абзаца абзацу абзацем абзаце абзацы абзацев".split(),
}
ABBREVIATIONS = ["ст", "п", "ч", "ред", "г"]
CLOSING = "»”\"')]}"
MONTHS = dict(zip("января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(), range(1, 13)))
CRITICAL_TYPES = ["requirement", "decision", "gate", "risk", "evidence"]
CHECKING_EDGES = ["checked_by", "validated_by", "requires_proof"]
