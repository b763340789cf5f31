"""Rules on Python sources, as predicates over facts.python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.rules import shell as sig
from gneiss.rules.base import ENTRY_POINTS, rule

# fixed values: names the rules look for
WEAK_HASHES = ("hashlib.md5", "hashlib.sha1")
RANDOM_FUNCTIONS = ("random", "randint", "randrange", "choice", "getrandbits", "shuffle", "sample", "uniform")
SECURITY_CONTEXT = r"(?i)(token|password|passwd|secret|nonce|salt|otp|csrf|credential|session[_-]?id|api[_-]?key|private[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key|auth[_-]?code|verification)"
SECRET_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|apikey|private[_-]?key)"
LOCATION_NAME = r"(?i)_(path|file|dir|folder|location)$"
HTTP_CALL = r"^(requests|httpx)\.(get|post|put|delete|patch|head|options|request)$"
# fixed values: arguments and functions that bind to an address
HOST_ARGUMENTS = ("host", "hostname", "bind", "address", "addr", "interface", "server_address", "listen")
BIND_FUNCTIONS = ("bind", "run", "serve", "create_server", "run_server", "make_server", "listen")
HOST_NAME = r"(?i)host|bind|addr|interface|listen"
# fixed values: loaders that run what they load
UNSAFE_LOADERS = (
    "pickle.load", "pickle.loads", "_pickle.load", "_pickle.loads", "marshal.load", "marshal.loads", "cloudpickle.load", "cloudpickle.loads", "dill.load", "dill.loads", "joblib.load", "yaml.unsafe_load",
)
# fixed values: parsers of XML
XML_MODULES = r"^(xml\.etree|xml\.dom|xml\.sax|lxml\.etree|ElementTree)"
XML_PARSERS = ("parse", "fromstring", "XML", "iterparse", "parseString")
# fixed values: words of checks, places of temporary files
SECURITY_ASSERT = r"(?i)(auth|admin|permission|allowed|is_owner|authorized|can_)"
TEMP_PATH = r"^/(var/)?tmp(/|$)"
PATH_NAME = r"(?i)path|dir|tmp|temp|file|dest|output|target|cache|location"
PATH_FUNCTIONS = ("open", "join", "makedirs", "mkdir", "Path", "NamedTemporaryFile", "TemporaryFile")
# fixed values: functions that decode
DECODERS = (
    "b64decode", "b85decode", "a85decode", "b32decode", "b16decode", "decodebytes", "urlsafe_b64decode", "unhexlify", "a2b_base64", "a2b_hex", "decompress",
)
# fixed values: functions that fetch, shells, and what runs or reads code
FETCHERS = ("get", "post", "urlopen", "urlretrieve", "request")
SHELLS = r"(^|[\s'\"/])(sh|bash|zsh|dash|ksh|csh|tcsh|ash|fish)(['\"\s]|$)"
READ_SINKS = ("open", "fdopen", "Path", "PosixPath", "WindowsPath")
CODE_EXECUTION = ("system", "popen", "Popen", "call", "run", "eval", "exec", "__import__")
# fixed values: calls that make memory executable
EXECUTABLE_MEMORY = ("VirtualAlloc", "VirtualAllocEx", "VirtualProtect", "VirtualProtectEx", "mprotect")
# fixed values: what a setup script should not run
SETUP_EXECUTION = ("system", "popen", "check_call", "check_output", "Popen", "eval", "exec", "compile", "urlopen", "urlretrieve")
KNOWN_VARIABLES = ("PATH", "HOME", "USER", "SHELL", "LANG", "TERM", "PWD", "TMPDIR", "EDITOR", "DISPLAY", "CI")

CALL, ATTR, FULL = F.col("kind") == "call", F.col("args")["attr"], F.col("args")["full"]


def arg(name: str) -> Column:
    return F.col("args")[name]


def kw(name: str) -> Column:
    return F.col("args")[f"kw:{name}"]


def flag(name: str) -> Column:
    return F.array_contains("flags", name)


def last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def nested(names) -> Column:
    return F.exists("names", lambda x: last(x).isin(*names))


def pick(facts: DataFrame, condition: Column, evidence: Column | None = None) -> DataFrame:
    return facts.where(condition).withColumn("evidence", evidence if evidence is not None else F.coalesce(arg("code"), F.col("name")))


def number(name: str) -> Column:
    return arg(name).cast("int")


def imports_any(facts: DataFrame, pattern: str) -> DataFrame:
    return facts.where((F.col("kind") == "import") & F.col("name").rlike(pattern)).select("path").distinct()


def predicate(rule_id: str, category: str, severity: str, verdict: str, condition: Column, refs: str = "", evidence: Column | None = None, needs: str | None = None, framework: str | None = None, reads: str = ""):
    """A rule that is one condition on a fact, in files that import `needs` if that is given."""

    shown = evidence if evidence is not None else F.coalesce(arg("code"), F.col("name"))

    def run(facts):
        rows = facts if needs is None else facts.join(imports_any(facts, needs), "path", "left_semi")
        return pick(rows, condition, shown)

    rule(rule_id, category, severity, verdict, "python", refs, framework, lambda: (condition, shown), needs, reads=reads)(run)


SA, PYDANTIC = r"^sqlalchemy(\.|$)", r"^pydantic"
FUNCTION, CLASS, ASSIGN = F.col("kind") == "function", F.col("kind") == "class", F.col("kind") == "assign"
TEST_PLACE = r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$"
TEST = FUNCTION & F.col("name").startswith("test") & F.col("path").rlike(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|conftest\.py$")
ROUTE = F.exists("flags", lambda x: x.rlike(r"^decorator:(get|post|put|delete|patch|route|websocket|head|options)$"))
SEC = "security"
RESOLVED = F.coalesce(FULL, F.col("name"))

# ---------------------------------------------------------------- security
predicate("PY-SEC-ASSERT-FOR-SECURITY", SEC, "medium", "candidate", (F.col("kind") == "assert") & F.col("name").rlike(SECURITY_ASSERT), "bandit:B101 owasp:A04", reads="assert")
predicate(
    "PY-SEC-BIND-ALL-INTERFACES", SEC, "low", "auto",
    CALL & (F.exists(F.array(*[kw(k) for k in HOST_ARGUMENTS]), lambda v: F.coalesce(v.contains("0.0.0.0"), F.lit(False))) | ATTR.isin(*BIND_FUNCTIONS) & F.coalesce(arg("arg0"), F.lit("")).contains("'0.0.0.0'"))
    | ASSIGN & (F.col("name").rlike(HOST_NAME)) & F.coalesce(arg("text") == "0.0.0.0", F.lit(False)), "bandit:B104 owasp:A05", reads="assign call")
predicate("PY-SEC-DANGEROUS-EVAL", SEC, "blocking", "auto", CALL & F.col("name").isin("eval", "exec", "compile") & arg("arg0").isNotNull() & (arg("arg0_kind") != "const"), "bandit:B307 owasp:A03", reads="call")
TAINTED = (arg("arg0_kind") == "built") & (flag("arg0_param") | flag("arg0_subscript"))
predicate("PY-SEC-DJANGO-RAW-SQL", SEC, "high", "candidate", CALL & ATTR.isin("raw", "extra") & TAINTED, "owasp:A03", reads="call")
predicate("PY-SEC-SQL-STRING-BUILD", SEC, "high", "candidate", CALL & ATTR.isin("execute", "executemany") & TAINTED, "bandit:B608 owasp:A03", reads="call")
predicate("PY-SEC-FLASK-DEBUG", SEC, "medium", "auto", CALL & (ATTR == "run") & (kw("debug") == "True"), "bandit:B201 owasp:A05", reads="call")
predicate(
    "PY-SEC-HARDCODED-SECRET", SEC, "high", "auto",
    ASSIGN & last(F.col("name")).rlike(SECRET_NAME) & (F.length(arg("text")) > 0) & ~last(F.col("name")).rlike(LOCATION_NAME) & ~arg("text").rlike(r"^(/|\./|\.\./|~/)"), "bandit:B105 owasp:A07", F.col("name"), reads="assign")
predicate(
    "PY-SEC-INSECURE-RANDOM", SEC, "medium", "candidate",
    CALL & FULL.rlike(r"^random\.") & ATTR.isin(*RANDOM_FUNCTIONS) & (F.coalesce(arg("target").rlike(SECURITY_CONTEXT), F.lit(False)) | F.coalesce(F.col("fn").rlike(SECURITY_CONTEXT), F.lit(False))), "bandit:B311 owasp:A02", reads="call")
predicate(
    "PY-SEC-INSECURE-TEMPFILE", SEC, "medium", "auto",
    CALL & ((FULL == "tempfile.mktemp") | ATTR.isin(*PATH_FUNCTIONS) & (arg("arg0_kind") == "const") & F.coalesce(arg("arg0"), F.lit("")).rlike(r"^['\"]/(var/)?tmp(/|['\"])")) | ASSIGN & F.col("name").rlike(PATH_NAME) & F.coalesce(arg("text"), F.lit("")).rlike(TEMP_PATH),
    "bandit:B306 bandit:B108 owasp:A05", reads="assign call")
predicate("PY-SEC-INSECURE-TLS", SEC, "high", "auto", CALL & ((kw("verify") == "False") | (kw("check_hostname") == "False") | (ATTR == "_create_unverified_context")) | ASSIGN & F.col("name").endswith(".check_hostname") & (arg("value") == "False"), "bandit:B501 owasp:A02", reads="assign call")
predicate("PY-SEC-JINJA-AUTOESCAPE-OFF", SEC, "medium", "auto", CALL & (ATTR == "Environment") & (kw("autoescape").isNull() | (kw("autoescape") == "False")), "bandit:B701 owasp:A03", reads="call")
predicate("PY-SEC-PARAMIKO-AUTOADD", SEC, "medium", "auto", CALL & F.col("name").rlike(r"(AutoAddPolicy|WarningPolicy)$"), "bandit:B507 owasp:A07", reads="call")
predicate("PY-SEC-PATH-TRAVERSAL", SEC, "medium", "candidate", CALL & (F.col("name") == "open") & (arg("arg0_kind") == "built") & flag("arg0_names"), "owasp:A01", reads="call")
predicate("PY-SEC-REQUEST-NO-TIMEOUT", SEC, "medium", "auto", CALL & FULL.rlike(HTTP_CALL) & kw("timeout").isNull() & ~flag("star"), "bandit:B113 owasp:A06", reads="call")
predicate("PY-SEC-SHELL-INJECTION", SEC, "high", "auto", CALL & (FULL.isin("os.system", "os.popen") | FULL.rlike(r"^subprocess\.") & (kw("shell") == "True")), "bandit:B602 bandit:B605 owasp:A03", reads="call")
predicate("PY-SEC-SSRF", SEC, "medium", "candidate", CALL & FULL.rlike(HTTP_CALL) & (F.coalesce(arg("arg0_kind"), F.lit("const")) != "const") & (flag("arg0_param") | flag("arg0_subscript")), "owasp:A10", reads="call")
predicate("PY-SEC-UNSAFE-DESERIALIZE", SEC, "high", "auto", CALL & (FULL.isin(*UNSAFE_LOADERS) | (FULL == "yaml.load") & ~F.coalesce(kw("Loader"), arg("arg1"), F.lit("")).rlike(r"Safe|Base")), "bandit:B301 bandit:B506 owasp:A08", reads="call")
predicate("PY-SEC-WEAK-HASH", SEC, "medium", "auto", CALL & (FULL.isin(*WEAK_HASHES) | (FULL == "hashlib.new") & F.coalesce(arg("arg0"), F.lit("")).rlike(r"^['\"](md5|sha1)['\"]$")) & (F.coalesce(kw("usedforsecurity"), F.lit("")) != "False"), "bandit:B303 bandit:B324 owasp:A02", reads="call")


@rule("PY-SEC-XXE-UNSAFE-XML", SEC, "medium", "auto", "python", "bandit:B313 owasp:A05", reads="call import")
def unsafe_xml(facts):
    safe = imports_any(facts, "^defusedxml")
    return pick(facts, CALL & RESOLVED.rlike(XML_MODULES) & ATTR.isin(*XML_PARSERS)).join(safe, "path", "left_anti")


predicate("SA-RAW-SQL", SEC, "high", "candidate", CALL & ATTR.isin("text", "execute") & (arg("arg0_kind") == "built") & flag("arg0_names"), "fw:sqlalchemy", needs=SA, framework="sqlalchemy", reads="call import")

# ---------------------------------------------------------------- malware and supply chain
LITERAL = F.col("kind") == "literal"
EXECUTES = CALL & F.col("name").isin("eval", "exec")
predicate("PY-MAL-CRYPTO-MINER", "malware", "high", "auto", LITERAL & F.col("name").rlike(sig.MINER), reads="literal")
predicate("PY-MAL-ENCODED-BLOB", "malware", "medium", "candidate", LITERAL & (F.col("name").rlike(sig.BASE64_BLOB) | F.col("name").rlike(sig.HEX_BLOB)), reads="literal")
predicate("PY-MAL-EXFIL-URL", "malware", "medium", "candidate", LITERAL & F.col("name").rlike(sig.EXFIL_URL), reads="literal")
predicate("PY-SECRET-DETECTED", "secrets", "high", "auto", LITERAL & F.col("name").rlike(sig.CREDENTIALS), reads="literal")
predicate("PY-MAL-CREDENTIAL-ACCESS", "malware", "high", "candidate", CALL & ATTR.isin(*READ_SINKS) & F.coalesce(arg("arg0"), F.lit("")).rlike(sig.SENSITIVE_PATHS), reads="call")
predicate("PY-MAL-DOWNLOAD-EXEC", "malware", "high", "auto", CALL & ATTR.isin("system", "popen", "Popen", "run", "call", "check_call", "check_output") & F.coalesce(arg("code"), F.lit("")).rlike(sig.PIPE_TO_SHELL), reads="call")
predicate("PY-MAL-DYNAMIC-IMPORT", "malware", "medium", "candidate", CALL & ATTR.isin("__import__", "import_module") & nested((*DECODERS, "chr", "fromhex")), reads="call")
predicate("PY-MAL-OBFUSCATED-EXEC", "malware", "blocking", "auto", EXECUTES & nested(DECODERS), reads="call")
predicate("PY-MAL-REMOTE-EXEC", "malware", "blocking", "auto", EXECUTES & nested(FETCHERS), reads="call")
predicate("PY-MAL-REVERSE-SHELL", "malware", "blocking", "auto", CALL & ((ATTR == "dup2") & nested(("fileno",)) | (ATTR == "spawn") & F.coalesce(arg("arg0"), F.lit("")).rlike(SHELLS)), reads="call")
predicate("PY-MAL-PICKLE-REDUCE", "malware", "high", "candidate", (F.col("kind") == "return") & F.col("fn").isin("__reduce__", "__reduce_ex__") & last(F.coalesce(arg("head"), F.lit(""))).isin(*CODE_EXECUTION), reads="return")
predicate("PY-SUPPLY-SETUP-EXEC", "supply-chain", "medium", "candidate", CALL & F.col("path").rlike(r"(^|/)setup\.py$") & ATTR.isin(*SETUP_EXECUTION) & (flag("module_scope") | F.col("fn").isin("run", "initialize_options", "finalize_options")), reads="call")


@rule("PY-MAL-SHELLCODE", "malware", "blocking", "auto", reads="call")
def shellcode(facts):
    memory = facts.where(CALL & (ATTR.isin(*EXECUTABLE_MEMORY) | (ATTR == "mmap") & F.coalesce(arg("code"), F.lit("")).contains("PROT_EXEC"))).select("path").distinct()
    return pick(facts, CALL & ATTR.isin("CFUNCTYPE", "WINFUNCTYPE")).join(memory, "path", "left_semi")


# ---------------------------------------------------------------- correctness
predicate("PY-CORRECT-BROAD-EXCEPT", "correctness", "medium", "auto", (F.col("kind") == "except") & (flag("bare") | F.exists("names", lambda x: x.isin("Exception", "BaseException"))) & ~flag("raises") & ~flag("uses_name"), reads="except")
predicate("PY-CORRECT-NAIVE-DATETIME", "correctness", "suggestion", "candidate", CALL & RESOLVED.rlike(r"(^|\.)datetime\.(utcnow|utcfromtimestamp|now)$") & (ATTR.isin("utcnow", "utcfromtimestamp") | arg("arg0").isNull() & kw("tz").isNull()), reads="call")
predicate("PY-CORRECT-RAISE-WITHOUT-FROM", "correctness", "low", "candidate", (F.col("kind") == "raise") & flag("no_cause"), reads="raise")
predicate("PY-CORRECT-SWALLOWED-EXCEPTION", "correctness", "medium", "candidate", (F.col("kind") == "except") & flag("silent") & ~((F.size("names") > 0) & F.forall("names", lambda x: last(x).isin("StopIteration", "StopAsyncIteration", "GeneratorExit", "KeyboardInterrupt", "SystemExit", "CancelledError"))), reads="except")
predicate("PY-PYDANTIC-V1-CONFIG-CLASS", "correctness", "medium", "candidate", CLASS & flag("inner_config") & F.exists("names", lambda x: last(x) == "BaseModel"), "fw:pydantic", framework="pydantic", reads="class")
RELATIONSHIP = CALL & (ATTR == "relationship")
COLUMN = CALL & ATTR.isin("mapped_column", "Column")
predicate("SA-JOINED-COLLECTION", "correctness", "medium", "auto", RELATIONSHIP & F.coalesce(kw("lazy"), F.lit("")).rlike(r"^['\"]joined['\"]$") & F.coalesce(arg("annotation"), F.lit("")).rlike(r"(?i)\[\s*(list|set|sequence|collection)"), "fw:sqlalchemy", needs=SA, framework="sqlalchemy", reads="call import")
predicate("SA-LAZY-DYNAMIC", "correctness", "low", "candidate", RELATIONSHIP & F.coalesce(kw("lazy"), F.lit("")).rlike(r"^['\"](dynamic|subquery)['\"]$"), "fw:sqlalchemy", needs=SA, framework="sqlalchemy", reads="call import")
predicate("SA-MUTABLE-DEFAULT", "correctness", "medium", "candidate", COLUMN & (arg("kw_kind:default") == "mutable"), "fw:sqlalchemy", needs=SA, framework="sqlalchemy", reads="call import")
predicate("SA-NAIVE-DATETIME-DEFAULT", "correctness", "low", "candidate", COLUMN & F.coalesce(kw("default"), F.lit("")).rlike(r"utcnow|func\.now\(|datetime\.now$") & kw("server_default").isNull(), "fw:sqlalchemy", needs=SA, framework="sqlalchemy", reads="call import")

# ---------------------------------------------------------------- async
predicate("PY-ASYNC-DANGLING-TASK", "async", "high", "auto", CALL & flag("bare") & FULL.isin("asyncio.create_task", "asyncio.ensure_future"), reads="call")
predicate("PY-ASYNC-NO-AWAIT-BODY", "async", "low", "candidate", FUNCTION & flag("async") & ~flag("awaits") & ~flag("stub") & ~flag("yields") & ~ROUTE & ~flag("decorator:abstractmethod") & ~flag("decorator:overload"), reads="function")
predicate("PY-ASYNC-SYNC-IO", "async", "high", "candidate", CALL & flag("in_async") & ~flag("awaited") & (FULL.isin("time.sleep", "open", "input", "os.system", "urllib.request.urlopen", "httpx.Client") | FULL.rlike(r"^(requests|subprocess)\.(get|post|put|delete|patch|head|options|request|run|call|check_call|check_output|Popen)$") | FULL.rlike(r"^httpx\.(get|post|put|delete|patch|head|options|request)$")), reads="call")
predicate("PY-ASYNC-UNLOCKED-LAZY-INIT", "async", "high", "candidate", (F.col("kind") == "if") & flag("lazy_init") & flag("in_async") & flag("awaits") & ~flag("locked"), reads="if")
predicate("SA-ASYNC-EXPIRE-ON-COMMIT", "async", "medium", "candidate", CALL & ((ATTR == "async_sessionmaker") | (ATTR == "sessionmaker") & F.coalesce(kw("class_"), F.lit("")).contains("AsyncSession")) & (F.coalesce(kw("expire_on_commit"), F.lit("")) != "False") & ~flag("star"), "fw:sqlalchemy", needs=SA, framework="sqlalchemy", reads="call import")
predicate("SA-IMPLICIT-LAZY-ASYNC", "async", "medium", "candidate", RELATIONSHIP & kw("lazy").isNull() & ~flag("star"), "fw:sqlalchemy", needs=r"^sqlalchemy\.ext\.asyncio", framework="sqlalchemy", reads="call import")


@rule("PY-ASYNC-SEQUENTIAL-AWAITS", "async", "low", "candidate", reads="await")
def sequential_awaits(facts):
    loops = facts.where((F.col("kind") == "await") & flag("in_for")).groupBy("path", "n").agg(F.bool_and(flag("with_bound")).alias("bound"), F.min("name").alias("evidence"))
    return loops.where(~F.col("bound")).select("path", F.col("n").alias("line"), "evidence")


@rule("PY-ASYNC-UNAWAITED-COROUTINE", "async", "high", "auto", reads="call function")
def unawaited(facts):
    coroutines = facts.where(FUNCTION & flag("async") & ~flag("yields")).select("path", F.col("cls").alias("owner"), F.col("name").alias("target"), flag("method").alias("method")).distinct()
    calls = pick(facts, CALL & flag("bare") & ~flag("awaited"))
    free = calls.join(coroutines.where(~F.col("method")).select("path", "target").distinct(), ["path"]).where(F.col("name") == F.col("target"))
    own = calls.join(coroutines.where("method"), "path").where((F.col("name") == F.concat(F.lit("self."), "target")) & (F.col("cls") == F.col("owner")))
    return free.select("path", "line", "evidence").union(own.select("path", "line", "evidence"))


# ---------------------------------------------------------------- config, typing, style
ENV_NAME = F.regexp_extract(F.coalesce(arg("key"), arg("arg0"), F.lit("")), r"^['\"](\w+)['\"]$", 1)
predicate("PY-CONFIG-ADHOC-ENV", "config", "low", "auto", (CALL & FULL.isin("os.getenv", "os.environ.get") | (F.col("kind") == "subscript") & (F.col("name") == "os.environ") & ~flag("store")) & ~ENV_NAME.isin(*KNOWN_VARIABLES), reads="call subscript")
predicate("PY-CONFIG-IMPORT-TIME-IO", "config", "medium", "candidate", CALL & flag("module_scope") & ~flag("chained") & (FULL.isin("open", "os.system", "urllib.request.urlopen", "socket.create_connection") | FULL.rlike(r"^(requests|httpx|subprocess)\.\w+$")), reads="call")
predicate("PY-TYPING-MISSING-HINTS", "typing", "low", "auto", FUNCTION & (flag("unannotated") | flag("no_return_type")), reads="function")
predicate("PY-TYPING-UNTYPED-DICT", "typing", "medium", "auto", FUNCTION & ~ROUTE & F.coalesce(arg("annotations"), F.lit("")).rlike(r"(^|; |\| )(dict|list|Dict|List)( \||;|$)|[dD]ict\[[^\]]*\bAny\b|[dD]ict\[\w+, [dD]ict\["), evidence=arg("annotations"), reads="function")
predicate("PY-STYLE-FILE-SIZE", "style", "low", "auto", (F.col("kind") == "module") & (F.col("n") > 800), evidence=F.col("n").cast("string"), reads="module")
predicate("PY-STYLE-IF-FALSE-IMPORT", "style", "low", "auto", (F.col("kind") == "import") & flag("if_false"), reads="import")
predicate("PY-STYLE-INLINE-IMPORT", "style", "medium", "auto", (F.col("kind") == "import") & flag("in_function"), reads="import")


@rule("PY-STYLE-LONG-COMMENT", "style", "low", "candidate")
def long_comment(facts, most: int = 3):
    from gneiss.facts.lines import comment_blocks

    alone = facts.where((F.col("kind") == "comment") & flag("alone")).select("path", "line", F.col("name").alias("text"))
    code = facts.where(~F.col("kind").isin("comment", "module", "error")).groupBy("path").agg(F.min("line").alias("starts"))
    blocks = comment_blocks(alone, 2).where(F.col("prose") > most).join(code, "path", "left")
    return blocks.where(F.col("first") > F.coalesce("starts", F.lit(1 << 30))).select("path", F.col("first").alias("line"), F.col("prose").cast("string").alias("evidence"))


def named_files():
    return F.regexp_extract_all("name", F.lit(r"[\w/]+\.py"), F.lit(0))


def file_names():
    own = F.when(F.col("kind").isin("module", "error"), F.array("path", F.element_at(F.split("path", "/"), -1)))
    return own.when(F.col("kind") == "comment", named_files())


@rule("PY-STYLE-STALE-COMMENT", "style", "low", "candidate", units=file_names, reads="comment error module")
def stale_comment(facts):
    named = facts.where(F.col("kind") == "comment").select("path", "line", F.explode(named_files()).alias("evidence"))
    named = named.where(~F.element_at(F.split("evidence", "/"), -1).isin("setup.py", "conftest.py", "__init__.py", "__main__.py", "manage.py"))
    known = facts.where(F.col("kind").isin("module", "error")).select(F.col("path").alias("known")).distinct()
    known = known.select(F.explode(F.array("known", F.element_at(F.split("known", "/"), -1))).alias("evidence")).distinct()
    return named.withColumn("full", F.col("evidence")).join(known, "evidence", "left_anti").select("path", "line", "evidence", F.col("evidence").alias("unit"))


# ---------------------------------------------------------------- composition
OOP = "oop-composition"
BASE_MODEL = F.exists("names", lambda x: last(x) == "BaseModel")
predicate("PY-OOP-BUILDER-CLASS", OOP, "low", "candidate", CLASS & arg("producer").isin("build", "create", "make", "construct", "produce") & (flag("has_init") | F.col("name").endswith("Builder")), reads="class")
predicate("PY-OOP-CLOSURE-CAPTURE", OOP, "suggestion", "candidate", FUNCTION & flag("captures") & ~F.col("path").rlike(TEST_PLACE), evidence=F.concat_ws(": ", "name", arg("captured")), reads="function")
predicate("PY-OOP-CONSTRUCTOR-WALL", OOP, "low", "candidate", CALL & (F.col("n") >= 12) & last(F.col("name")).rlike("^[A-Z]"), reads="call")
predicate("PY-OOP-DATACLASS-IN-PYDANTIC", OOP, "medium", "auto", CLASS & flag("decorator:dataclass"), needs=PYDANTIC, reads="class import")
predicate("PY-OOP-DICT-MUTATION-BUILDER", OOP, "suggestion", "candidate", FUNCTION & flag("mutates_param") & ~F.exists("flags", lambda x: x.rlike("^decorator:.*validator$")), reads="function")
predicate("PY-OOP-FIELD-COPY", OOP, "low", "candidate", FUNCTION & (number("copies") >= 4), reads="function")
predicate("PY-OOP-FLAT-FIELD-MODEL", OOP, "suggestion", "candidate", CLASS & BASE_MODEL & (number("n_fields") >= 10), reads="class")
predicate("PY-OOP-GOD-CLASS", OOP, "low", "candidate", CLASS & ((number("n_methods") > 20) | (number("n_attrs") > 15)), reads="class")
predicate("PY-OOP-HIGH-COMPLEXITY", OOP, "low", "candidate", FUNCTION & (number("complexity") > 10), reads="function")
predicate("PY-OOP-LONG-PARAM-LIST", OOP, "low", "candidate", FUNCTION & (number("n_params") > 6), reads="function")
predicate("PY-OOP-MODEL-REBUILD", OOP, "suggestion", "candidate", CALL & (ATTR == "model_rebuild"), reads="call")
predicate("PY-OOP-STATIC-METHOD-CLASS", OOP, "low", "candidate", CLASS & flag("all_static"), reads="class")
predicate("PY-OOP-THIN-WRAPPER", OOP, "low", "candidate", FUNCTION & flag("forwards") & ~flag("method"), reads="function")


@rule("PY-OOP-DISPATCH-LADDER", OOP, "low", "candidate", reads="function if")
def dispatch_ladder(facts, least: int = 5):
    chains = facts.where((F.col("kind") == "if") & flag("first") & flag("one_key") & (F.col("n") >= least)).select("path", "line", "scope", F.col("args")["key"].alias("evidence"))
    guards = facts.where(FUNCTION & (number("guards") >= least)).select("path", "line", F.concat_ws(".", F.nullif("scope", F.lit("")), "name").alias("scope"), F.lit("guards").alias("evidence"))
    return chains.union(guards).groupBy("path", "scope").agg(F.min(F.struct("line", "evidence")).alias("m")).select("path", "m.line", "m.evidence")


@rule("PY-OOP-DUPLICATE-BLOCK", OOP, "low", "candidate", reads="block")
def duplicate_block(facts):
    from gneiss.operators.crossfile import repeated_blocks

    b = repeated_blocks(facts.where(F.col("kind") == "block").select("path", F.col("sig").alias("block_hash"), "line"))
    return b.select("path", F.element_at("lines", 1).alias("line"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("evidence"))


@rule("PY-OOP-PARALLEL-SIBLING", OOP, "low", "candidate", reads="function")
def parallel_sibling(facts):
    from gneiss.operators.crossfile import near_twins

    s = facts.where(FUNCTION & ~F.col("name").startswith("test") & (number("size") >= 12) & (number("n_statements") >= 1)).select("path", F.col("sig").alias("skeleton_hash"), arg("literals").alias("literals"), "line")
    return near_twins(s, 2).select("path", "line", F.col("n").cast("string").alias("evidence"))


@rule("PY-OOP-TWIN-METHODS", OOP, "low", "candidate", reads="function")
def twin_methods(facts):
    m = facts.where(FUNCTION & flag("method") & (number("n_statements") >= 3))
    g = m.groupBy("path", "sig").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.countDistinct("name").alias("names"), F.countDistinct("cls").alias("classes"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("evidence"))
    return g.where((F.col("n") >= 2) & ~((F.col("names") == 1) & (F.col("classes") > 1))).select("path", "line", "evidence")


@rule("PY-OOP-FREE-FN-ORCHESTRATOR", OOP, "low", "candidate", reads="function import")
def orchestrator(facts, least: int = 3):
    f = facts.where(FUNCTION & ~flag("method") & ~flag("nested"))
    cli = facts.where((F.col("kind") == "import") & F.col("name").rlike("^(typer|click|argparse)")).select("path").distinct()
    p = f.select("path", "line", "name", F.explode(F.split(arg("params"), ",")).alias("param"), "names").where("param <> ''").join(cli, "path", "left_anti")
    groups = p.groupBy("path", "param").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.collect_set("name").alias("fns"), F.collect_list("names").alias("called"))
    callers = F.size(F.filter("called", lambda c: F.arrays_overlap(c, F.col("fns"))))
    hits = groups.where((F.col("n") >= least) & (callers >= 2))
    return hits.groupBy("path").agg(F.min(F.struct("line", "param")).alias("m")).select("path", "m.line", F.col("m.param").alias("evidence"))


@rule("PY-OOP-LOGIC-IN-CLI", OOP, "low", "candidate", reads="call import")
def logic_in_cli(facts, least: int = 3):
    cli = facts.where((F.col("kind") == "import") & F.col("name").rlike("^(typer|click)")).select("path").distinct()
    work = FULL.rlike(r"^(subprocess|shutil)\.") | ATTR.isin("write_text", "write_bytes", "unlink", "mkdir", "rmtree", "rename", "replace_file", "symlink_to")
    g = facts.where(CALL & work & F.col("fn").isNotNull()).join(cli, "path", "left_semi").groupBy("path", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    return g.where(F.col("n") >= least).select("path", "line", F.col("scope").alias("evidence"))


@rule("PY-OOP-MODULE-CONST-FOR-SUBCLASS", OOP, "suggestion", "candidate", reads="assign class")
def constants_for_subclass(facts, least: int = 2):
    consts = facts.where(ASSIGN & flag("module_scope") & F.col("name").rlike("^[A-Z][A-Z0-9_]+$")).select("path", F.col("name").alias("const"), F.col("line").alias("at"))
    classes = facts.where(CLASS & (F.size("names") > 0)).select("path", "line", F.col("name").alias("evidence"), F.upper(F.regexp_replace("name", "(?<=[a-z0-9])(?=[A-Z])", "_")).alias("prefix"))
    hits = classes.join(consts, "path").where(F.col("const").startswith(F.concat("prefix", F.lit("_"))))
    return hits.groupBy("path", "line", "evidence").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- tests
T = "testing"
predicate("PY-TEST-FIXTURE-MUTABLE-WIDE-SCOPE", T, "medium", "candidate", FUNCTION & flag("decorator:fixture") & F.coalesce(arg("decorators"), F.lit("")).rlike(r"scope\s*=\s*['\"](session|module|package)") & flag("returns_mutable"), "fw:pytest", framework="pytest", reads="function")
predicate("PY-TEST-LOGIC-IN-TEST", T, "low", "candidate", TEST & flag("control"), "fw:pytest", framework="pytest", reads="function")
predicate("PY-TEST-OVER-MOCKING", T, "low", "candidate", TEST & (number("mocks") > 4), "fw:pytest", framework="pytest", reads="function")
predicate("PY-TEST-SKIP-NO-REASON", T, "low", "candidate", FUNCTION & F.coalesce(arg("decorators"), F.lit("")).rlike(r"mark\.(skip|skipif|xfail)\b(?!\(['\"])") & ~F.coalesce(arg("decorators"), F.lit("")).contains("reason"), "fw:pytest", framework="pytest", reads="function")
predicate("PY-TEST-SLEEP", T, "low", "candidate", CALL & (FULL == "time.sleep") & F.coalesce(F.col("fn").startswith("test"), F.lit(False)), "fw:pytest", framework="pytest", reads="call")


@rule("PY-TEST-NO-ASSERTION", T, "medium", "candidate", refs="fw:pytest", framework="pytest", reads="function")
def no_assertion(facts):
    local = facts.where(FUNCTION & ~F.col("name").startswith("test")).groupBy("path").agg(F.collect_set("name").alias("helpers"))
    t = facts.where(TEST & ~flag("asserts") & ~flag("stub")).join(local, "path", "left")
    calls_helper = F.coalesce(F.arrays_overlap("names", "helpers"), F.lit(False))
    return t.where(~calls_helper).withColumn("evidence", F.col("name"))


def _test_groups(facts, key: str, least_statements: int, least: int):
    t = facts.where(TEST & (number("n_statements") >= least_statements) & ~F.coalesce(arg("decorators"), F.lit("")).contains("parametrize"))
    g = t.groupBy("path", (F.col("sig") if key == "sig" else arg(key)).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(arg("body")).alias("bodies"), F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("evidence"))
    return g.where((F.col("n") >= least) & F.col("key").isNotNull())


@rule("PY-TEST-PARAMETRIZE-CANDIDATE", T, "medium", "candidate", refs="fw:pytest", framework="pytest", reads="function")
def parametrize_candidate(facts):
    return _test_groups(facts, "sig", 2, 3)


@rule("PY-TEST-DUPLICATE-SETUP", T, "low", "candidate", refs="fw:pytest", framework="pytest", reads="function")
def duplicate_setup(facts):
    return _test_groups(facts, "setup", 3, 3).where("bodies > 1")


# ---------------------------------------------------------------- repository level, over symbol facts
# fixed values: module names that a framework reads
MAGIC_NAMES = ("revision", "down_revision", "branch_labels", "depends_on", "pytestmark")


def names_of(*kinds):
    """A rule's units: the names of facts of some kinds."""
    return lambda: F.when(F.col("kind").isin(*kinds), F.array("name"))


@rule("PY-DEAD-SYMBOL", "dead-code", "low", "candidate", units=names_of("symbol_def", "symbol_ref"), beside=("module",), reads="module symbol_def symbol_ref")
def dead_symbol(facts):
    from gneiss.operators.crossfile import dead_symbols
    from gneiss.sources.files import role

    private = F.col("name").rlike("^_") & arg("what").isin("function", "class")
    defs = facts.where((F.col("kind") == "symbol_def") & ~flag("registers") & (private | (arg("what") == "constant")) & ~F.col("name").isin(*MAGIC_NAMES, *ENTRY_POINTS, ""))
    roles = facts.where(F.col("kind") == "module").select("path", role(F.col("path"), F.lit(""), F.col("flags")).alias("role"))
    return dead_symbols(defs.join(roles, "path"), facts.where(F.col("kind") == "symbol_ref")).withColumn("evidence", F.col("name")).withColumn("unit", F.col("name"))


@rule("PY-XFILE-PRIVATE-USED", OOP, "low", "candidate", units=names_of("symbol_def", "symbol_ref"), reads="symbol_def symbol_ref")
def private_used(facts):
    from gneiss.operators.crossfile import leaked_private

    mine = facts.where(~F.col("path").rlike(r"(^|/)tests?/|(^|/)test_[^/]*\.py$"))
    defs = mine.where((F.col("kind") == "symbol_def") & F.col("name").rlike("^_[^_]"))
    refs = mine.where((F.col("kind") == "symbol_ref") & F.col("name").rlike("^_[^_]"))
    hits = leaked_private(defs.select("name", "path"), refs.select("name", "path"))
    return hits.join(defs.groupBy("name", "path").agg(F.min("line").alias("line")), ["name", "path"]).select("path", "line", F.concat_ws(": ", "name", "files").alias("evidence"), F.col("name").alias("unit"))


def fixture_names():
    own = F.when(FUNCTION, F.array_union(F.array("name"), F.split(F.coalesce(arg("params"), F.lit("")), ",")))
    return own.when(LITERAL, F.array("name"))


@rule("PY-TEST-UNUSED-FIXTURE", T, "low", "candidate", refs="fw:pytest", framework="pytest", units=fixture_names, reads="function literal")
def unused_fixture(facts):
    fixtures = facts.where(FUNCTION & flag("decorator:fixture") & ~F.coalesce(arg("decorators"), F.lit("")).contains("autouse"))
    requested = facts.where(FUNCTION).select(F.explode(F.split(arg("params"), ",")).alias("name"))
    named = facts.where(LITERAL).select("name")
    return fixtures.join(requested.union(named).distinct(), "name", "left_anti").withColumn("evidence", F.col("name")).withColumn("unit", F.col("name"))


def _duplicates(facts, condition, key="sig"):
    shapes = facts.where(condition & F.col(key).isNotNull()).select("path", "line", "name", F.col(key).alias("shape_hash"))
    often = shapes.groupBy("shape_hash").agg(F.countDistinct("path").alias("n_paths")).where("n_paths >= 2")
    return shapes.join(often, "shape_hash").withColumn("evidence", F.col("name")).withColumn("unit", F.col("shape_hash"))


def shapes_of(condition):
    """A rule's units: the signatures of facts that meet a condition."""
    return lambda: F.when(condition() & F.col("sig").isNotNull(), F.array("sig"))


def plain_function():
    return FUNCTION & (number("n_statements") >= 3) & ~F.col("name").startswith("test") & ~F.exists("flags", lambda x: x.rlike("^decorator:(command|callback)$"))


@rule("PY-XFILE-DUP-MODEL", OOP, "low", "candidate", units=shapes_of(lambda: CLASS & BASE_MODEL), reads="class")
def duplicate_model(facts):
    return _duplicates(facts, CLASS & BASE_MODEL)


@rule("PY-XFILE-DUP-FUNCTION", OOP, "low", "candidate", units=shapes_of(plain_function), reads="function")
def duplicate_function(facts):
    return _duplicates(facts, plain_function())


# any class can join or split a hierarchy, so all classes are one unit
@rule("PY-CONFIG-SCATTERED-SETTINGS", "config", "low", "candidate", units=lambda: F.when(CLASS, F.array(F.lit("settings"))), reads="class")
def scattered_settings(facts):
    from gneiss.operators.crossfile import descendants, home, outside_home

    c = facts.where(CLASS)
    edges = c.select("name", F.explode("names").alias("base")).select("name", last(F.col("base")).alias("base"))
    roots = facts.sparkSession.createDataFrame([("BaseSettings",)], "name string")
    members = c.join(descendants(edges, roots).where("depth > 0").select("name"), "name", "left_semi").select("name", "line", "path", F.lit("production").alias("role"))
    homes = home(members, "role", "path")
    return outside_home(members, homes, "role", "path").withColumn("evidence", F.col("name")).withColumn("unit", F.lit("settings"))


@rule("SA-GREENLET-ATTR-AFTER-COMMIT", "async", "medium", "candidate", refs="fw:sqlalchemy", framework="sqlalchemy", reads="assign call import return")
def attribute_after_commit(facts):
    from gneiss.operators.findings import read_after_commit

    f = facts.where(F.col("fn").isNotNull()).join(imports_any(facts, r"^sqlalchemy\.ext\.asyncio"), "path", "left_semi")
    commit = f.where(CALL & (ATTR == "commit") & flag("awaited")).select("path", "fn", F.lit(None).cast("string").alias("name"), "line", F.lit("commit").alias("what"))
    bind = f.where(ASSIGN & F.col("name").rlike(r"^\w+$")).select("path", "fn", "name", "line", F.lit("bind").alias("what"))
    fresh = f.where(CALL & (ATTR == "refresh")).select("path", "fn", arg("arg0").alias("name"), "line", F.lit("refresh").alias("what"))
    # an access is an attribute of a local name in a return, an assignment's value or an argument
    text = F.when(F.col("kind") == "return", F.col("name")).when(ASSIGN, arg("value")).when(CALL, arg("arg0"))
    reads = f.where(F.col("kind").isin("return", "assign", "call")).select("path", "fn", "line", F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w.])([a-z_]\w*)\.[a-z_]\w*(?!\w*\()"), F.lit(1))).alias("name"))
    bound = bind.select("path", "fn", "name").distinct()
    access = reads.join(bound, ["path", "fn", "name"], "left_semi").select("path", "fn", "name", "line", F.lit("access").alias("what"))
    hits = read_after_commit(commit.unionByName(bind).unionByName(fresh).unionByName(access))
    return hits.select("path", "line", F.col("name").alias("evidence")).distinct()
