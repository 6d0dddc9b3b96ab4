"""Fixed dimensions: situations, rules, criteria, rubric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Situation code, title, conformance level.
SITUATIONS = [
    ("ACC1", "Difficulty directly accessing files", "A"),
    ("ACC2/COM3", "Difficulty accessing/comprehending images", "A"),
    ("ACC3/COM4", "Difficulty accessing/comprehending graphs", "AA"),
    ("ACC4", "Difficulty accessing collection items", "AA"),
    ("ACC5", "Difficulty accessing expandable/collapsed content", "A"),
    ("ACC6", "Difficulty accessing a query suggestion", "AAA"),
    ("COM1", "Difficulty understanding a digital library structure", "A"),
    ("COM2/NAV1", "Difficulty understanding/navigating the search filtering structure", "AAA"),
    ("EVA1", "Difficulty assessing relevance of a collection or an item", "A"),
    ("EXE1", "Difficulty clearing a search box", "A"),
    ("EXE2", "Difficulty exiting an open item", "A"),
    ("EXE3", "Difficulty returning to a previous page", "AA"),
    ("FIL1", "Difficulty finding/locating an icon-based search feature", "A"),
    ("FIL2/RED3", "Difficulty finding/locating/distinguishing search features at different levels", "AA"),
    ("FIL3/HEP1", "Difficulty finding/locating/using mobile-specific help information", "A"),
    ("INT1", "Difficulty interacting with multi-layered windows", "A"),
    ("NAV2", "Difficulty navigating paginated sections", "AA"),
    ("NAV3", "Difficulty navigating through search results", "AA"),
    ("NAV4", "Difficulty navigating within an item", "AA"),
    ("NAV5", "Difficulty navigating to a search result section", "A"),
    ("RED1", "Difficulty recognizing the availability of search results", "A"),
    ("RED2", "Difficulty distinguishing collection titles from thumbnails", "AA"),
    ("RED4", "Difficulty recognizing authorized features", "AAA"),
    ("USE1", "Difficulty using screen readers and voice activated commands", "AAA"),
]

# Rule id, code, level, kind, criteria, in the order in which rules run.
RULES = [
    ("file-links", "ACC1", "A", "fix", "2.4.4, 3.2.2, 4.1.2"),
    ("images-alt", "ACC2/COM3", "A", "fix+flag", "1.1.1"),
    ("graphs-longdesc", "ACC3/COM4", "AA", "fix+flag", "1.1.1"),
    ("collection-items", "ACC4", "AA", "fix", "1.3.1"),
    ("disclosure", "ACC5", "A", "fix", "4.1.2, 4.1.3"),
    ("autocomplete", "ACC6", "AAA", "fix", "4.1.2"),
    ("landmarks", "COM1", "A", "fix", "1.3.1, 2.4.1"),
    ("filter-groups", "COM2/NAV1", "AAA", "fix", "1.3.1"),
    ("result-relevance", "EVA1", "A", "fix", "2.4.4"),
    ("clear-search", "EXE1", "A", "fix", "2.1.1"),
    ("dialog-escape", "EXE2/INT1", "A", "fix", "2.1.2, 4.1.2"),
    ("back-affordance", "EXE3", "AA", "fix", "2.4.8"),
    ("icon-buttons", "FIL1/USE1", "A", "fix", "4.1.2"),
    ("search-regions", "FIL2/RED3", "AA", "fix", "1.3.1"),
    ("help-affordance", "FIL3/HEP1", "A", "fix", ""),
    ("pagination", "NAV2", "AA", "fix", "1.3.1, 2.4.1"),
    ("results-status", "RED1/NAV3/NAV5", "A", "fix", "4.1.3"),
    ("within-item-nav", "NAV4", "AA", "fix", "2.4.1, 2.4.5"),
    ("authorized-features", "RED4", "AAA", "fix", "4.1.2"),
    ("media-captions", "MED1", "A", "fix", "1.2.1, 1.2.2, 1.2.3"),
    ("images-nontag", "ACC2/COM3", "A", "flag", "1.1.1"),
    ("form-fields", "FORM1", "A", "fix", "1.3.1, 3.3.2, 4.1.2"),
]

# What a score means.
RUBRIC = [
    (1, "Non-compliance"), (2, "Severe, pervasive problems"), (3, "Major gaps"), (4, "Partial"),
    (5, "Mostly compliant"), (6, "Compliant with negligible nits"), (7, "Full compliance"),
]


def situations(spark: SparkSession) -> DataFrame:
    """``(ix, code, title, level)``, 24 rows."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SITUATIONS)], "ix int, code string, title string, level string")


def situation_tokens(spark: SparkSession) -> DataFrame:
    """``(code, token, token_ix)``: the parts of compound codes."""
    rows = [(c, t, i) for c, _, _ in SITUATIONS for i, t in enumerate(c.split("/"))]
    return spark.createDataFrame(rows, "code string, token string, token_ix int")


#: What each rule does, by its id.
DESCRIPTIONS = {
    "file-links": "Names links to files by title, format and size, and says when they open a new window.",
    "images-alt": "Asks for words where images have none or only a file name; hides thumbnails that repeat a link's text.",
    "graphs-longdesc": "Makes charts images with a name and a place for a long description.",
    "collection-items": "Makes groups of cards lists, whose items say which of how many they are.",
    "disclosure": "Makes show and hide controls buttons that say what they control and whether it is open.",
    "autocomplete": "Makes search fields with suggestions comboboxes.",
    "landmarks": "Adds a skip link and a main landmark, and names navigation.",
    "filter-groups": "Makes clusters of filters named groups.",
    "result-relevance": "Names results by title, format and snippet.",
    "clear-search": "Makes what clears a search a named button.",
    "dialog-escape": "Makes open overlays modal dialogs and hides what lies behind them.",
    "back-affordance": "Makes breadcrumbs navigation with the current page marked.",
    "icon-buttons": "Names controls that show only an icon by that icon.",
    "search-regions": "Tells several searches on one page apart by name.",
    "help-affordance": "Names links to help and support.",
    "pagination": "Makes pagers navigation with the current page marked and its arrows named.",
    "results-status": "Adds a status, a skip link and each result's place to results.",
    "within-item-nav": "Names the page controls of viewers.",
    "authorized-features": "Says why restricted controls can't be used.",
    "media-captions": "Asks for captions and transcripts of video and audio.",
    "images-nontag": "Asks for words for drawings, canvases and background images.",
    "form-fields": "Names form fields by the label beside them or their placeholder, and says which are required.",
}


def rules_catalog(spark: SparkSession) -> DataFrame:
    """``(rule_ix, rule_id, code, level, kind, criteria, describe)``, 22 rows."""
    return spark.createDataFrame([(i, *r, DESCRIPTIONS[r[0]]) for i, r in enumerate(RULES)], "rule_ix int, rule_id string, code string, level string, kind string, criteria string, describe string")


# Short labels of codes.
CODE_LABELS = {
    "ACC1": "file link", "ACC2": "needs alt text", "ACC3": "chart description", "ACC4": "list semantics", "ACC5": "disclosure state", "ACC6": "search combobox", "COM1": "skip link",
    "COM2": "filter group", "COM3": "needs alt text", "NAV2": "pager landmark", "NAV3": "nav status", "RED1": "live status", "RED2": "decorative image", "RED4": "disabled state",
    "EXE1": "clear control", "EXE2": "dialog", "EXE3": "breadcrumb", "EVA1": "item context", "FIL1": "icon label", "FIL2": "search region", "INT1": "dialog focus",
    "MED1": "media captions", "FORM1": "form label",
}


def code_labels(spark: SparkSession) -> DataFrame:
    """``(code, label)``."""
    return spark.createDataFrame(list(CODE_LABELS.items()), "code string, label string")


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBRIC, "score int, meaning string")
