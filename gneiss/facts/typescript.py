"""Facts about TypeScript, JavaScript and JSX, from a small scanner: no grammar, but strings, comments, templates, brackets and
markup are told apart, which is what the rules need.

Same schema as facts.python.  kinds: module, import, literal, call, element, component, nested, function.
For elements: name is the tag, args its attributes (a bare attribute is "true", code keeps its braces), n the depth, sig the
shape of its subtree, flags: text, self_closing, spread; names the tags of its element children; scope the parent's number.
"""

from __future__ import annotations

import re

from bisect import bisect_left

from pyspark.sql import DataFrame

from gneiss.facts import language
from gneiss.facts.python import digest, rows_of

BEFORE_MARKUP = re.compile(r"(?:^|[(,=:?\[{}&|;>]|\breturn|\bdefault|=>)\s*$")
TAG = re.compile(r"[A-Za-z][\w.:-]*")
ATTRIBUTE = re.compile(r"[A-Za-z_][\w:.-]*")
CALL = re.compile(r"(?<![\w$.])(new\s+)?((?:[A-Za-z_$][\w$]*)(?:\??\.[A-Za-z_$][\w$]*)*)\s*(?:<[^<>()]*>)?\(")
IMPORT = re.compile(r"^[ \t]*import\s+(type\s+)?([^;'\"]*?\s*from\s*)?(['\"])", re.M)
COMPONENT = re.compile(r"(?P<ex>export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s+(?P<a>[A-Z]\w*)\s*(?:<[^>]*>)?\(|const\s+(?P<b>[A-Z]\w*)\s*(?::[^=\n]+)?=\s*(?:React\.)?(?:memo\(|forwardRef\()?\s*(?:async\s*)?\()")
FUNCTION = re.compile(r"(?:function\s+(?P<a>[a-z_$]\w*)\s*(?:<[^>]*>)?\(|const\s+(?P<b>[a-z_$]\w*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?\()")
# fixed values: hooks that hold state or effects; reading a context is added
HOOKS = ("useState", "useEffect", "useLayoutEffect", "useMemo", "useCallback", "useReducer", "useRef", "useImperativeHandle", "useTransition") + ("useContext",)
WORD = re.compile(r"[A-Za-z_$][\w$]*")


class Scanner:
    def __init__(self, path: str, source: str, kinds: frozenset[str] | None = None):
        self.path, self.source, self.kinds = path, source, kinds
        self.ends = [i for i, c in enumerate(source) if c == "\n"]
        self.clean = list(source)  # comments and string contents blanked
        self.rows: list[tuple] = []
        self.elements: list[dict] = []
        self.spans: list[tuple[int, int]] = []  # strings

    def line(self, i: int) -> int:
        return bisect_left(self.ends, i) + 1

    def add(self, kind, i, name="", flags=(), args=None, names=(), n=0, sig=None, scope=""):
        if self.kinds is not None and kind not in self.kinds:
            return
        self.rows.append((self.path, kind, self.line(i), name, scope, None, None, sorted(set(flags)), {k: v for k, v in (args or {}).items() if v is not None}, list(names), n, sig))

    def blank(self, a: int, b: int) -> None:
        for k in range(a, min(b, len(self.clean))):
            if self.clean[k] != "\n":
                self.clean[k] = " "

    def string(self, i: int) -> int:
        """i is at a quote; returns the place after the string.  Code in templates is scanned."""
        quote, j, s = self.source[i], i + 1, self.source
        while j < len(s) and s[j] != quote:
            if s[j] == "\\":
                j += 1
            elif quote == "`" and s.startswith("${", j):
                self.blank(i + 1, j)
                self.code(j + 2, "}")
                j = self.at - 1
            elif quote != "`" and s[j] == "\n":
                break
            j += 1
        value = s[i + 1 : j]
        if value:
            self.add("literal", i, value, ["template"] * (quote == "`"), n=len(value))
        self.spans.append((i, j))
        if quote != "`":
            self.blank(i + 1, j)
        self.at = j + 1
        return j + 1

    def code(self, i: int, stop: str | None, depth: int = 0, parent: int = -1) -> int:
        """Scans code from i to the bracket `stop` that closes it; self.at is the place after it."""
        s, level = self.source, 0
        while i < len(s):
            c = s[i]
            if s.startswith("//", i):
                j = s.find("\n", i)
                j = len(s) if j < 0 else j
                self.blank(i, j)
                i = j
            elif s.startswith("/*", i):
                j = s.find("*/", i)
                j = len(s) if j < 0 else j + 2
                self.blank(i, j)
                i = j
            elif c in "'\"`":
                i = self.string(i)
            elif c == "<" and i + 1 < len(s) and (s[i + 1].isalpha() or s[i + 1] == ">") and BEFORE_MARKUP.search("".join(self.clean[max(0, i - 40) : i])) and self.markup_ahead(i):
                i = self.markup(i, depth, parent)
            elif c in "([{":
                level += 1
                i += 1
            elif c in ")]}":
                if level == 0 and c == stop:
                    self.at = i + 1
                    return i + 1
                level -= 1
                i += 1
            else:
                i += 1
        self.at = i
        return i

    def markup_ahead(self, i: int) -> bool:
        """Not a type parameter list: what follows the tag looks like an attribute or an end."""
        m = TAG.match(self.source, i + 1)
        rest = self.source[m.end() if m else i + 1 : (m.end() if m else i + 1) + 200]
        return bool(re.match(r"\s*(/?>|\{|[A-Za-z_][\w:-]*(\s*=|\s|/?>))", rest)) and not re.match(r"\s*(extends\b|,)", rest) and not re.match(r">\s*\(", rest)

    def markup(self, i: int, depth: int, parent: int) -> int:
        s = self.source
        m = TAG.match(s, i + 1)
        tag, j = (m[0], m.end()) if m else ("", i + 1)
        me = {"at": i, "tag": tag, "attrs": {}, "flags": set(), "children": [], "depth": depth + 1, "parent": parent, "code": False}
        number = len(self.elements)
        self.elements.append(me)
        if parent >= 0:
            self.elements[parent]["children"].append(number)
        while j < len(s):
            while j < len(s) and s[j].isspace():
                j += 1
            if s.startswith("/>", j):
                me["flags"].add("self_closing")
                return j + 2
            if s.startswith(">", j):
                j += 1
                break
            if s.startswith("{", j):
                me["flags"].add("spread")
                j = self.code(j + 1, "}", depth + 1, number)
                continue
            a = ATTRIBUTE.match(s, j)
            if not a:
                j += 1
                continue
            j, value = a.end(), "true"
            while j < len(s) and s[j].isspace():
                j += 1
            if s.startswith("=", j):
                j += 1
                while j < len(s) and s[j].isspace():
                    j += 1
                begin = j
                if s[j : j + 1] in ("'", '"'):
                    j = self.string(j)
                    value = s[begin + 1 : j - 1]
                elif s[j : j + 1] == "{":
                    j = self.code(j + 1, "}", depth + 1, -1)
                    value = s[begin:j]
            me["attrs"][a[0]] = value
        while j < len(s):
            if s.startswith("</", j):
                end = s.find(">", j)
                return len(s) if end < 0 else end + 1
            if s[j] == "<":
                j = self.markup(j, depth + 1, number)
            elif s[j] == "{":
                k = self.code(j + 1, "}", depth + 1, number)
                inner = "".join(self.clean[j + 1 : k - 1]).strip()
                if inner and not inner.startswith("<"):
                    me["code"] = True
                j = k
            else:
                if not s[j].isspace():
                    me["flags"].add("text")
                j += 1
        return j

    def shape(self, k: int) -> str:
        e = self.elements[k]
        return f"{e['tag']}({','.join(self.shape(c) for c in e['children'])})"

    def size(self, k: int) -> int:
        return 1 + sum(self.size(c) for c in self.elements[k]["children"])

    def argument(self, i: int) -> str:
        """The first argument of a call whose bracket is at i."""
        level, j = 0, i + 1
        while j < len(self.text):
            c = self.text[j]
            if c in "([{":
                level += 1
            elif c in ")]}":
                if level == 0:
                    break
                level -= 1
            elif c == "," and level == 0:
                break
            j += 1
        return self.source[i + 1 : j].strip()

    def closing(self, i: int, brackets: str = "([{") -> int:
        """The place after the bracket that closes the one at i."""
        level = 0
        for j in range(i, len(self.text)):
            if self.text[j] in "([{":
                level += 1
            elif self.text[j] in ")]}":
                level -= 1
                if level == 0:
                    return j + 1
        return len(self.text)

    def body(self, i: int) -> tuple[str, int, int]:
        """(parameters, start, end) of a function whose parameter bracket is at i."""
        end = self.closing(i)
        m = re.compile(r"\s*(?::[^={]+)?(?:=>)?\s*").match(self.text, end)
        start = m.end() if m else end
        stop = self.closing(start) if self.text[start : start + 1] in ("{", "(") else self.text.find("\n", start)
        return self.source[i + 1 : end - 1], start, stop if stop > 0 else len(self.text)

    def run(self) -> list[tuple]:
        s = self.source
        if self.kinds == {"module"}:
            self.add("module", 0, n=s.count("\n") + (not s.endswith("\n")))
            return self.rows
        self.code(0, None)
        self.text = text = "".join(self.clean)
        self.add("module", 0, n=s.count("\n") + (not s.endswith("\n")))
        for m in IMPORT.finditer(text):
            q = m.end() - 1
            end = s.find(s[q], q + 1)
            self.add("import", m.start() + len(m[0]) - len(m[0].lstrip()), s[q + 1 : end], ["type"] * bool(m[1]), names=WORD.findall((m[2] or "").replace("from", "")))
        for m in CALL.finditer(text):
            if m[2] in ("if", "for", "while", "switch", "return", "function", "catch", "typeof", "await"):
                continue
            i = m.end() - 1
            end = self.closing(i)
            arg = self.argument(i)
            kind = "none" if not arg else "template" if arg[0] == "`" and "${" in arg else "string" if arg[0] in "'\"`" and arg[-1] == arg[0] and "+" not in text[i:end] else "async_function" if re.match(r"async\b", arg) else "other"
            inside = [x[2] for x in CALL.finditer(text, i + 1, end)]
            self.add("call", m.start(), m[2].replace("?.", "."), ["new"] * bool(m[1]), {"arg0": arg, "arg0_kind": kind, "all": s[i:end][:1000]}, inside)
        for k, e in enumerate(self.elements):
            flags = e["flags"] | ({"code"} if e["code"] else set())
            names = [self.elements[c]["tag"] for c in e["children"]]
            extra = {"children": ",".join(map(str, e["children"])) or None, "size": str(self.size(k)), "number": str(k)}
            self.add("element", e["at"], e["tag"], flags, {f"@{a}": v for a, v in e["attrs"].items()} | extra, names, e["depth"], digest(self.shape(k)), str(e["parent"]))
        self.functions()
        return self.rows

    def functions(self) -> None:
        for m in COMPONENT.finditer(self.text):
            params, a, b = self.body(m.end() - 1)
            inside = [e for e in self.elements if a <= e["at"] < b]
            if not inside:
                continue
            name = m["a"] or m["b"]
            props = re.match(r"\s*\{(.*?)\}", params, re.S)
            n_props = len([p for p in re.split(r",(?![^{(\[]*[})\]])", props[1]) if p.strip()]) if props else 0
            own = self.text[a:b]
            hooks = [h for h in CALL.findall(own) if h[1].split(".")[-1] in HOOKS]
            local = set(WORD.findall(params)) | set(WORD.findall(" ".join(x for x in re.findall(r"\b(?:const|let|var)\s+([^=;]+?)\s*=", own))))
            skeleton, literals = self.skeleton(a, b)
            self.add("component", m.start(), name, ["exported"] * bool(m["ex"]), {"n_props": str(n_props), "hooks": str(len(hooks)), "literals": digest(repr(literals)), "size": str(len(skeleton))}, [], n=max(e["depth"] for e in inside), sig=digest(skeleton))
            for f in re.finditer(r"\bfunction\s+([a-z]\w*)\s*\(", own):
                p, x, y = self.body(a + f.end() - 1)
                used = set(WORD.findall(self.text[x:y])) - set(WORD.findall(p)) - {f[1]}
                self.add("nested", a + f.start(), f[1], ["pure"] * (not used & (local - {f[1]})), scope=name)
        for m in FUNCTION.finditer(self.text):
            params, a, b = self.body(m.end() - 1)
            if "=>" not in self.text[m.end() - 1 : a] and not m["a"]:
                continue
            skeleton, literals = self.skeleton(a, b)
            given = [p for p in params.split(",") if p.strip()]
            self.add("function", m.start(), m["a"] or m["b"], [], {"n_params": str(len(given)), "literals": digest(repr(literals)), "size": str(len(skeleton))}, sig=digest(skeleton), n=self.text.count("\n", a, b))

    def skeleton(self, a: int, b: int) -> tuple[str, list[str]]:
        """Code with names blanked but for called and member names; literals in order."""
        literals = [self.source[x : y + 1] for x, y in self.spans if a <= x < b] + re.findall(r"(?<![\w.])\d[\w.]*", self.text[a:b])
        code = re.sub(r"(?<![\w.])\d[\w.]*", "0", re.sub(r"([\"'`])\s*\1", '""', self.text[a:b]))
        names = re.sub(r"(?<![.\w$])[A-Za-z_$][\w$]*(?!\s*\()(?![\w$])", lambda w: w[0] if w[0] in ("return", "if", "else", "for", "const", "let", "await", "async", "new") else "_", code)
        return re.sub(r"\s+", " ", names), literals


def facts_of(path: str, source: str | None, kinds: frozenset[str] | None = None) -> list[tuple]:
    return Scanner(path, source or "", kinds).run()


@language("typescript")
def facts(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The facts of files(path, text); of some kinds only, if given."""
    chosen = None if kinds is None else frozenset(kinds)
    return rows_of(files, lambda path, source: facts_of(path, source, chosen))
