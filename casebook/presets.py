"""Presets for the rule operators.

FIXED VALUES — these must equal the values of the analysis this library
re-expresses for its results to agree (bins, keyword lists, recode sets,
month names, score cut-offs, request defaults).  They are plain data; every
operator takes them as parameters, so callers can pass their own.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (begin)
# ---------------------------------------------------------------------------

# Age bins: value < edge -> label, checked in order; the rest -> top label.
AGE_EDGES_PROFILING = [(18, "Child"), (30, "Young Adult"), (50, "Adult"), (65, "Middle Age")]
AGE_EDGES_MODEL = [(18, "Child"), (30, "Young Adult"), (50, "Adult"), (65, "Middle Aged")]
AGE_TOP = "Senior"
AGE_UNKNOWN = "Unknown"

# Out-of-range flag: value < low or value > high.
FLAG_LOW = 18
FLAG_HIGH = 65

# Keyword groups: lower-cased substring test, first group that matches wins.
KEYWORD5 = [
    ("Firearm", ["firearm", "gun", "handgun", "shotgun", "rifle"]),
    ("Knife", ["knife", "cut", "stab"]),
    ("Blunt", ["blunt"]),
    ("Strangulation", ["strangulation"]),
]
KEYWORD5_MODEL = [
    ("Firearm", ["firearm", "gun", "handgun", "shotgun", "rifle"]),
    ("Knife", ["knife", "cut", "stab"]),
    ("Blunt Object", ["blunt"]),
    ("Strangulation", ["strangulation"]),
]
KEYWORD5_NARROW = [
    ("Firearm", ["firearm", "gun"]),
    ("Knife", ["knife", "cut"]),
    ("Blunt Object", ["blunt"]),
    ("Strangulation", ["strangulation"]),
]
KEYWORD3 = [
    ("Firearm", ["firearm", "gun"]),
    ("Knife", ["knife"]),
]
KEYWORD_OTHER = "Other"
KEYWORD_NULL = "Unknown"

# Relationship recode: exact, case-sensitive membership, first set wins.
RELATION_GROUPS = [
    ("Family", ["Spouse", "Common-law spouse", "Parent", "Child", "Sibling", "In-law"]),
    ("Acquaintance", ["Friend", "Acquaintance", "Neighbor", "Boyfriend/Girlfriend", "Ex-spouse"]),
    ("Stranger", ["Stranger"]),
]
RELATION_OTHER = "Other"
RELATION_NULL = "Unknown"

# Outcome label map; any other value -> null.
OUTCOME_MAP = {"Yes": 1, "No": 0}

# Month names -> month number; flag set for the month flag.
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]
MONTH_FLAG_SET = [1, 7, 12]

# Priority tiers on a probability (>=), with recommendation text.
TIERS5 = [
    (0.8, "HIGH PRIORITY", "Assign experienced investigators immediately"),
    (0.7, "MEDIUM-HIGH PRIORITY", "Assign dedicated investigator"),
    (0.6, "MEDIUM PRIORITY", "Standard investigation"),
    (0.5, "LOW-MEDIUM PRIORITY", "Basic investigation"),
]
TIERS5_DEFAULT = ("LOW PRIORITY", "Minimal resources, revisit if new evidence emerges")
OUTCOME_CUT = 0.5
OUTCOME_TEXT = ("Likely Solvable", "Likely Unsolvable")

# Service decision labels.
VERDICT_CUT = 0.55
VERDICT_TEXT = ("Resolved", "Unresolved")
PROFILE3 = [(0.75, "Cas Prioritaire"), (0.4, "Cas Standard")]  # strict >
PROFILE3_DEFAULT = "Cold Case Potentiel"
LOCALITY_CUT = 0.65  # strict >
URGENCY_CUT = 0.7  # strict >
VULNERABLE_TEXT = ("Vulnérable", "Adulte Standard")
VULNERABILITY_SCORE_TEXT = ("ÉLEVÉ", "MODÉRÉ")
ADVICE_TEXT = ("Focus sur preuves balistiques", "Recherche de témoins")
URGENCY_TEXT = ("ÉLEVÉE", "NORMALE")
MODEL_NOTE = "Random Forest Optimisé (AUC ~0.82)"

# Display bands in percent (documentation form): 0-20-40-60-80.
BANDS5 = [(0.8, "80-100%"), (0.6, "60-80%"), (0.4, "40-60%"), (0.2, "20-40%")]
BANDS5_DEFAULT = "0-20%"

# Prioritisation threshold table.
THRESHOLDS = [(0.8, "High Priority"), (0.7, "Medium Priority"), (0.6, "Low Priority")]

# High-potential open cases: strict > cut.
HIGH_POTENTIAL_CUT = 0.7

# Request defaults (scoring service).
REQUEST_DEFAULTS = {
    "age": 25.0, "victims": 1, "year": 2023, "historicalRate": 0.6,
    "sex": "Unknown", "race": "Unknown", "state": "Unknown", "weapon": "Other",
}

# Mining parameters.
ITEMSET_MIN_SUPPORT = 0.01
ITEMSET_MAX_LEN = 3
RULE_MIN_LIFT = 1.2
TOP_K_CATEGORIES = 15
SPLIT_TEST_FRACTION = 0.3
SPLIT_SEED = 42
CV_FOLDS = 5
SAMPLE_FRACTION = 0.3

# Cluster note rules: (relations that are hard to solve) and the note texts.
HARD_RELATIONS = ["Stranger", "Other", "Unknown"]
NOTE_HARD_RELATION = "High anonymity, low relational density → difficult to solve"
NOTE_KNOWN_RELATION = "Known offender – potential for witness leads"
NOTE_FIREARM = "Firearm used – ballistic evidence may exist"
NOTE_NO_WEAPON = "Missing weapon information – critical evidence gap"
NOTE_VULNERABLE = "Vulnerable victim – social network may have information"
NOTE_STATE = "Common state: %s – consider jurisdictional practices"

# Response texts of the scoring service.
FACTOR_LABELS = ("Fiabilité Modèle", "Facteur Arme", "Démographie", "Localisation")
FACTOR_WEAPON_TEXT = "Impact "
FACTOR_DEMOGRAPHY_TEXT = "Victime "
FACTOR_LOCALITY_TEXT = "Zone "
ANALYSIS_TEXT = "Probabilité de résolution : %s. Profil victime (%s) en %s suggère priorité %s. %s"
BALLISTIC_TEXT = "Analyse balistique recommandée."
ERROR_BAD_NUMBER = "Données numériques invalides"

# Texts that a CSV cell counts as missing.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
            "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# ---------------------------------------------------------------------------
# FIXED VALUES (end)
# ---------------------------------------------------------------------------

# Binding presets for the TPC-H test tables (ours): keys of the given tables pick
# words of the case domain, so that every arm of every rule occurs, and part
# names fall into groups of their own.
BIND_WEAPONS = ["Handgun", "Rifle", "Shotgun", "FIREARM", "Gun", "Knife", "stab wound", "Cutting tool", "Blunt Object",
                "Strangulation", "Poison", "Unknown", None]
BIND_RELATIONS = [r for _, group in RELATION_GROUPS for r in group] + ["spouse", "Employer", "Unknown", None]
BIND_SEXES = ["Male", "Female", "Unknown"]
ITEM_GROUPS = [
    ("Fastener", ["bolt", "rod"]),
    ("Machine", ["gear", "gizmo", "widget"]),
    ("Plate", ["plate", "ring"]),
]
SEGMENT_GROUPS = [
    ("Industry", ["MACHINERY", "BUILDING", "AUTOMOBILE"]),
    ("Home", ["HOUSEHOLD", "FURNITURE"]),
]


def cluster_notes(relation: str, weapon: str, sex: str | None = None,
                  age: str | None = None, region: str | None = None):
    """Cluster note rules keyed to the caller's column names."""
    from casebook.operators.kmodes import NoteRule
    rules = [
        NoteRule(relation, tuple(HARD_RELATIONS), NOTE_HARD_RELATION, NOTE_KNOWN_RELATION),
        NoteRule(weapon, ("Firearm",), NOTE_FIREARM),
        NoteRule(weapon, ("Unknown",), NOTE_NO_WEAPON),
    ]
    if sex and age:
        rules.append(NoteRule(sex, ("Female",), NOTE_VULNERABLE, and_column=age, and_values=("Child", "Senior")))
    if region:
        rules.append(NoteRule(region, (), NOTE_STATE, always=True))
    return rules
