"""Rules on TypeScript and JSX, as predicates over facts.typescript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.rules import shell as sig
from gneiss.rules.base import rule

# fixed values: elements that are interactive by themselves; media with controls are added
INTERACTIVE = ("a", "button", "input", "select", "textarea", "option", "label", "summary", "details") + ("video", "audio")
# fixed values: controls, labels and types the rules look for
CONTROLS = ("input", "select", "textarea")
LABELS = ("aria-label", "aria-labelledby", "title")
UNLABELLED_TYPES = ("hidden", "submit", "button", "reset", "image")
# fixed values: roles that elements have by themselves; the rest of the HTML standard's list that matters here is added
IMPLICIT_ROLES = {
    "a": "link", "button": "button", "nav": "navigation", "ul": "list", "ol": "list", "li": "listitem", "img": "img", "table": "table", "main": "main", "header": "banner", "footer": "contentinfo", "article": "article", "form": "form",
} | {"aside": "complementary", "h1": "heading", "h2": "heading", "h3": "heading"}
URL_ATTRIBUTES = ("href", "src", "to", "action", "formAction")
SHELL_SINKS = ("exec", "execSync", "spawn", "spawnSync")
ICON = r"(Icon$|^Icon|^svg$)"

ELEMENT, CALL, NAME, ARGS = F.col("kind") == "element", F.col("kind") == "call", F.col("name"), F.col("args")
NO = F.lit("")


def attr(name: str) -> Column:
    return ARGS[f"@{name}"]


def has(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | attr(n).isNotNull()
    return out


def flag(name: str) -> Column:
    return F.array_contains("flags", name)


def number(name: str) -> Column:
    return ARGS[name].cast("int")


def last(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def ts(rule_id: str, category: str, severity: str, verdict: str, condition: Column, evidence: Column | None = None, refs: str = "", reads: str = "") -> None:
    shown = evidence if evidence is not None else F.coalesce(ARGS["all"], NAME)
    rule(rule_id, category, severity, verdict, "typescript", refs, when=lambda: (condition, shown), reads=reads)(lambda facts: facts.where(condition).withColumn("evidence", shown))


EVAL = CALL & (NAME.isin("eval", "window.eval") | (NAME == "Function"))
ARG, KIND = F.coalesce(ARGS["arg0"], NO), F.coalesce(ARGS["arg0_kind"], NO)
LITERAL = F.col("kind") == "literal"

# security
ts("TS-SEC-DANGEROUS-EVAL", "security", "high", "auto", EVAL & (KIND != "none") & ((KIND != "string") | (NAME == "Function")) | CALL & NAME.isin("setTimeout", "setInterval") & KIND.isin("string", "template"), refs="owasp:A03")
ts("TS-SEC-DANGEROUS-HTML", "security", "high", "candidate", ELEMENT & has("dangerouslySetInnerHTML") & ~attr("dangerouslySetInnerHTML").rlike(r"__html:\s*(\"[^\"]*\"|'[^']*'|`[^`$]*`)\s*\}"), refs="owasp:A03")
ts("TS-SEC-JAVASCRIPT-URL", "security", "high", "auto", ELEMENT & F.exists(F.array(*[attr(a) for a in URL_ATTRIBUTES]), lambda v: F.coalesce(F.lower(v).rlike(r"^[{\s'\"`]*javascript:"), F.lit(False))), refs="owasp:A03")
ts("TS-SEC-TARGET-BLANK-NOOPENER", "security", "medium", "auto", ELEMENT & F.coalesce(attr("target"), NO).rlike(r"^[{'\"`]*_blank") & ~F.coalesce(attr("rel"), NO).rlike("noopener|noreferrer"), refs="owasp:A05")

# malware and secrets
SINK = CALL & last(NAME).isin(*SHELL_SINKS)
ts("TS-MAL-CREDENTIAL-ACCESS", "malware", "high", "candidate", LITERAL & NAME.rlike(sig.SENSITIVE_PATHS))
ts("TS-MAL-CRYPTO-MINER", "malware", "high", "auto", LITERAL & NAME.rlike(sig.MINER))
ts("TS-MAL-ENCODED-BLOB", "malware", "medium", "candidate", LITERAL & (NAME.rlike(sig.BASE64_BLOB) | NAME.rlike(sig.HEX_BLOB)))
ts("TS-MAL-EXFIL-URL", "malware", "medium", "candidate", LITERAL & NAME.rlike(sig.EXFIL_URL))
ts("TS-MAL-DOWNLOAD-EXEC", "malware", "high", "auto", SINK & F.coalesce(ARGS["all"], NO).rlike(sig.PIPE_TO_SHELL))
ts("TS-MAL-DYNAMIC-REQUIRE", "malware", "medium", "candidate", CALL & (NAME == "require") & ~KIND.isin("string", "none"))
ts("TS-MAL-EXEC-INJECTION", "malware", "high", "candidate", SINK & ~KIND.isin("string", "none"))
ts("TS-MAL-OBFUSCATED-EXEC", "malware", "blocking", "auto", EVAL & (F.array_contains("names", "atob") | F.coalesce(ARGS["all"], NO).rlike(r"\.from\([^)]*['\"](base64|base64url|hex)['\"]")))
ts("TS-MAL-REMOTE-EXEC", "malware", "blocking", "auto", EVAL & F.exists("names", lambda x: last(x).isin("fetch")))
ts("TS-SECRET-DETECTED", "secrets", "high", "auto", LITERAL & NAME.rlike(sig.CREDENTIALS))

# style
ts("TS-STYLE-FILE-SIZE", "style", "low", "auto", (F.col("kind") == "module") & (F.col("n") > 800), F.col("n").cast("string"), reads="module")


@rule("TS-STYLE-DUPLICATE-IMPORT", "style", "low", "auto", "typescript")
def duplicate_import(facts):
    i = facts.where((F.col("kind") == "import") & ~flag("type")).groupBy("path", "name").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return i.where(F.size("lines") > 1).select("path", F.element_at("lines", 2).alias("line"), F.col("name").alias("evidence"))


# accessibility
A = "a11y"
ts("TS-A11Y-ANCHOR-NO-HREF", A, "medium", "candidate", ELEMENT & (NAME == "a") & ~has("href") & ~flag("spread"))
ts("TS-A11Y-AUTOFOCUS", A, "low", "candidate", ELEMENT & has("autoFocus") & (F.coalesce(attr("autoFocus"), NO) != "{false}"))
ts("TS-A11Y-FORM-LABEL", A, "medium", "candidate", ELEMENT & NAME.isin(*CONTROLS) & ~has(*LABELS, "id") & ~flag("spread") & ~F.coalesce(attr("type"), NO).isin(*UNLABELLED_TYPES))
ts("TS-A11Y-IFRAME-TITLE", A, "medium", "candidate", ELEMENT & (NAME == "iframe") & ~has("title") & ~flag("spread"))
ts("TS-A11Y-IMG-NO-ALT", A, "medium", "candidate", ELEMENT & (NAME == "img") & ~has("alt", "aria-hidden") & ~flag("spread"))
ts("TS-A11Y-MOUSE-NO-KEY", A, "medium", "candidate", ELEMENT & (has("onMouseOver") & ~has("onFocus") | has("onMouseOut") & ~has("onBlur")))
ts("TS-A11Y-NONINTERACTIVE-ONCLICK", A, "medium", "candidate", ELEMENT & NAME.rlike("^[a-z]") & ~NAME.isin(*INTERACTIVE) & has("onClick") & ~has("role", "tabIndex") & ~flag("spread"))
ts("TS-A11Y-POSITIVE-TABINDEX", A, "medium", "candidate", ELEMENT & (F.regexp_extract(F.coalesce(attr("tabIndex"), NO), r"^[{'\"]*(\d+)", 1).try_cast("int") > 0))
ts("TS-A11Y-REDUNDANT-ROLE", A, "low", "candidate", ELEMENT & (F.element_at(F.create_map(*[F.lit(x) for kv in IMPLICIT_ROLES.items() for x in kv]), NAME) == attr("role")))
ts("TS-A11Y-ICON-BUTTON-NO-LABEL", A, "medium", "candidate", ELEMENT & NAME.rlike(r"(?i)^button$|Button$") & (F.size("names") == 1) & F.element_at("names", 1).rlike(ICON) & ~flag("text") & ~flag("code") & ~has(*LABELS))


@rule("TS-A11Y-DECORATIVE-ICON", A, "low", "candidate", "typescript")
def decorative_icon(facts):
    e = facts.where(ELEMENT)
    parents = e.where(flag("text")).select("path", F.explode(F.split(ARGS["children"], ",")).alias("child"))
    icons = e.where(NAME.rlike(ICON) & ~has("aria-hidden", "aria-label", "aria-labelledby", "title", "role", "alt") & ~flag("spread"))
    return icons.withColumn("child", ARGS["number"]).join(parents, ["path", "child"], "left_semi").withColumn("evidence", NAME)


# react
R = "react"
KEY = F.coalesce(attr("key"), NO)
ts("TS-REACT-RANDOM-KEY", R, "medium", "auto", ELEMENT & KEY.rlike(r"Math\.random|Date\.now|randomUUID"))
ts("TS-REACT-ARRAY-INDEX-KEY", R, "medium", "candidate", ELEMENT & KEY.rlike(r"^\{\s*(`[^`]*\$\{\s*(i|idx|index)\s*\}[^`]*`|(i|idx|index)(\.toString\(\))?|String\((i|idx|index)\))\s*\}$") & ~KEY.rlike(r"\b(item|row|entry|el)\."))
ts("TS-REACT-ASYNC-EFFECT", R, "medium", "auto", CALL & last(NAME).isin("useEffect", "useLayoutEffect") & (KIND == "async_function"))
ts("TS-REACT-EAGER-STATE-INIT", R, "medium", "candidate", CALL & (last(NAME) == "useState") & ARG.rlike(r"^(JSON\.parse\(|(window\.)?(local|session)Storage\.getItem\(|[\w.\[\]]+\.(map|filter|reduce|sort|flatMap)\()"))
COMPONENT = F.col("kind") == "component"
ts("TS-REACT-TOO-MANY-PROPS", R, "low", "candidate", COMPONENT & (number("n_props") > 6))
ts("TS-REACT-EXTRACTABLE-HOOK", R, "low", "candidate", COMPONENT & (number("hooks") >= 5))
ts("TS-REACT-EXTRACTABLE-HELPER", R, "low", "candidate", (F.col("kind") == "nested") & flag("pure"))


@rule("TS-REACT-DEEP-JSX-NESTING", R, "low", "candidate", "typescript")
def deep_nesting(facts, most: int = 6):
    deep = facts.where(ELEMENT & (F.col("n") > most)).groupBy("path").agg(F.min(F.struct("line", "name")).alias("m"))
    return deep.select("path", "m.line", F.col("m.name").alias("evidence"))


@rule("TS-REACT-MULTI-COMPONENT-FILE", R, "low", "candidate", "typescript")
def multi_component(facts):
    c = facts.where(COMPONENT).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("c"), F.bool_and(flag("exported")).alias("all_exported"))
    first = F.element_at("c.name", 1)
    family = F.col("all_exported") & F.forall("c.name", lambda x: F.substring(x, 1, 3) == F.substring(first, 1, 3))
    return c.where((F.size("c") > 1) & ~family).select("path", F.explode(F.slice("c", F.lit(2), F.size("c") - 1)).alias("x")).select("path", "x.line", F.col("x.name").alias("evidence"))


@rule("TS-REACT-REPEATED-JSX", R, "low", "candidate", "typescript")
def repeated_jsx(facts, least: int = 3, tags: int = 2):
    e = facts.where(ELEMENT & (F.col("scope") != "-1") & (number("size") >= tags))
    g = e.groupBy("path", "scope", "sig").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.min("name").alias("evidence"))
    return g.where(F.col("n") >= least)


@rule("TS-REACT-PARALLEL-SIBLING", R, "low", "candidate", "typescript")
def parallel_sibling(facts):
    from gneiss.operators.crossfile import near_twins

    s = facts.where((COMPONENT | (F.col("kind") == "function")) & (number("size") >= 20)).select("path", F.col("sig").alias("skeleton_hash"), ARGS["literals"].alias("literals"), "line")
    return near_twins(s, 2).select("path", "line", F.col("n").cast("string").alias("evidence"))


def across(rule_id: str, condition, reads: str) -> None:
    """A rule for shapes that stand in two files or more."""

    def run(facts: DataFrame) -> DataFrame:
        shapes = facts.where(condition()).select("path", "line", "name", F.col("sig").alias("shape_hash"))
        often = shapes.groupBy("shape_hash").agg(F.countDistinct("path").alias("n_paths")).where("n_paths >= 2")
        return shapes.join(often, "shape_hash").withColumn("evidence", F.col("name")).withColumn("unit", F.col("shape_hash"))

    rule(rule_id, R, "low", "candidate", "typescript", units=lambda: F.when(condition() & F.col("sig").isNotNull(), F.array("sig")), reads=reads)(run)


across("TS-XFILE-DUP-COMPONENT", lambda: COMPONENT & (number("size") >= 40), "component")
across("TS-XFILE-DUP-FUNCTION", lambda: (F.col("kind") == "function") & (F.col("n") >= 3), "function")
across("TS-XFILE-DUP-JSX-BLOCK", lambda: ELEMENT & (number("size") >= 5), "element")

# design system: silent until configured
DESIGN: dict = {"ui_paths": (), "components": (), "primitives": {}}


@rule("TS-DS-DIRECT-UI-IMPORT", "design-system", "medium", "candidate", "typescript")
def direct_ui_import(facts):
    hit = F.lit(False)
    for p in DESIGN["ui_paths"]:
        hit = hit | F.col("name").contains(p) & ~F.col("path").contains(p.strip("@/"))
    return facts.where((F.col("kind") == "import") & hit).withColumn("evidence", NAME)


@rule("TS-DS-INLINE-PRIMITIVE", "design-system", "medium", "candidate", "typescript")
def inline_primitive(facts):
    hit = F.lit(False)
    for pattern in DESIGN["primitives"].values():
        hit = hit | F.coalesce(attr("className"), NO).rlike(pattern)
    return facts.where(ELEMENT & NAME.rlike("^[a-z]") & hit).withColumn("evidence", attr("className"))


@rule("TS-DS-SIZE-OVERRIDE", "design-system", "low", "candidate", "typescript")
def size_override(facts):
    sized = F.coalesce(attr("className"), NO).rlike(r"(^|[\s'\"`{])(h|w|size|text|p|px|py)-(\d|\[|xs|sm|md|lg|xl)")
    return facts.where(ELEMENT & NAME.isin(*DESIGN["components"], "") & sized).withColumn("evidence", attr("className"))
