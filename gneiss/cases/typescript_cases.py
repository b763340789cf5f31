"""(rule, source that has it, source that doesn't)."""

DEEP = "export const A = () => (<div><p><b><i><u><s><em>x</em></s></u></i></b></p></div>)\n"
CASES = [
    ("TS-SEC-DANGEROUS-EVAL", "eval(code)\n", "evaluate(code)\n"),
    ("TS-SEC-DANGEROUS-HTML", "const A = () => <div dangerouslySetInnerHTML={{ __html: body }} />\n", "const A = () => <div dangerouslySetInnerHTML={{ __html: '<b>x</b>' }} />\n"),
    ("TS-SEC-JAVASCRIPT-URL", "const A = () => <a href=\"javascript:go()\">x</a>\n", "const A = () => <a href=\"/go\">x</a>\n"),
    ("TS-SEC-TARGET-BLANK-NOOPENER", "const A = () => <a href=\"/x\" target=\"_blank\">x</a>\n", "const A = () => <a href=\"/x\" target=\"_blank\" rel=\"noopener\">x</a>\n"),
    ("TS-MAL-CREDENTIAL-ACCESS", "const p = '/home/u/.ssh/id'\n", "const p = '/home/u'\n"),
    ("TS-MAL-CRYPTO-MINER", "const p = 'coinhive'\n", "const p = 'hive'\n"),
    ("TS-MAL-ENCODED-BLOB", f"const p = '{'QUJD' * 60}'\n", "const p = 'QUJD'\n"),
    ("TS-MAL-EXFIL-URL", "const p = 'https://webhook.site/a'\n", "// https://webhook.site/a\n"),
    ("TS-MAL-DOWNLOAD-EXEC", "exec('curl http://x | sh')\n", "print('curl http://x | sh')\n"),
    ("TS-MAL-DYNAMIC-REQUIRE", "const m = require(name)\n", "const m = require('fs')\n"),
    ("TS-MAL-EXEC-INJECTION", "child.execSync(`ls ${dir}`)\n", "child.execSync('ls')\n"),
    ("TS-MAL-OBFUSCATED-EXEC", "eval(atob(x))\n", "eval(x)\n"),
    ("TS-MAL-REMOTE-EXEC", "eval(await fetch(u))\n", "eval(u)\n"),
    ("TS-SECRET-DETECTED", "const k = 'ghp_" + "a1B2" * 9 + "'\n", "const k = 'ghp_'\n"),
    ("TS-STYLE-FILE-SIZE", "x()\n" * 801, "x()\n"),
    ("TS-STYLE-DUPLICATE-IMPORT", "import { a } from 'm'\nimport { b } from 'm'\n", "import { a } from 'm'\nimport type { B } from 'm'\n"),
    ("TS-A11Y-ANCHOR-NO-HREF", "const A = () => <a onClick={go}>x</a>\n", "const A = () => <a href=\"/\">x</a>\n"),
    ("TS-A11Y-AUTOFOCUS", "const A = () => <input id=\"a\" autoFocus />\n", "const A = () => <input id=\"a\" />\n"),
    ("TS-A11Y-DECORATIVE-ICON", "const A = () => <p><StarIcon /> Rate</p>\n", "const A = () => <p><StarIcon aria-hidden /> Rate</p>\n"),
    ("TS-A11Y-FORM-LABEL", "const A = () => <input type=\"text\" />\n", "const A = () => <input type=\"text\" aria-label=\"x\" />\n"),
    ("TS-A11Y-ICON-BUTTON-NO-LABEL", "const A = () => <button><StarIcon /></button>\n", "const A = () => <button aria-label=\"s\"><StarIcon /></button>\n"),
    ("TS-A11Y-IFRAME-TITLE", "const A = () => <iframe src=\"/x\" />\n", "const A = () => <iframe src=\"/x\" title=\"x\" />\n"),
    ("TS-A11Y-IMG-NO-ALT", "const A = () => <img src=\"/x\" />\n", "const A = () => <img src=\"/x\" alt=\"\" />\n"),
    ("TS-A11Y-MOUSE-NO-KEY", "const A = () => <p onMouseOver={f}>x</p>\n", "const A = () => <p onMouseOver={f} onFocus={f}>x</p>\n"),
    ("TS-A11Y-NONINTERACTIVE-ONCLICK", "const A = () => <div onClick={f}>x</div>\n", "const A = () => <div onClick={f} role=\"button\">x</div>\n"),
    ("TS-A11Y-POSITIVE-TABINDEX", "const A = () => <p tabIndex={2}>x</p>\n", "const A = () => <p tabIndex={0}>x</p>\n"),
    ("TS-A11Y-REDUNDANT-ROLE", "const A = () => <nav role=\"navigation\">x</nav>\n", "const A = () => <nav role=\"tablist\">x</nav>\n"),
    ("TS-REACT-ARRAY-INDEX-KEY", "const A = () => <ul>{xs.map((x, i) => <li key={i}>{x}</li>)}</ul>\n", "const A = () => <ul>{xs.map((x, i) => <li key={x.id}>{x}</li>)}</ul>\n"),
    ("TS-REACT-ASYNC-EFFECT", "useEffect(async () => { await f() }, [])\n", "useEffect(() => { f() }, [])\n"),
    ("TS-REACT-DEEP-JSX-NESTING", DEEP, "const A = () => <div><p>x</p></div>\n"),
    ("TS-REACT-EAGER-STATE-INIT", "const [a] = useState(JSON.parse(raw))\n", "const [a] = useState(() => JSON.parse(raw))\n"),
    ("TS-REACT-EXTRACTABLE-HELPER", "export function Aa({ x }) {\n  function add(a, b) { return a + b }\n  return <p>{add(x, 1)}</p>\n}\n", "export function Ab({ x }) {\n  function add(a) { return a + x }\n  return <p>{add(1)}</p>\n}\n"),
    ("TS-REACT-EXTRACTABLE-HOOK", "export function Ba() {\n  useState(1); useState(2); useRef(1); useMemo(f); useCallback(g)\n  return <p>x</p>\n}\n", "export function Bb() {\n  useState(1)\n  return <p>x</p>\n}\n"),
    ("TS-REACT-MULTI-COMPONENT-FILE", "export function Ca() {\n  return <p>x</p>\n}\nfunction Other() {\n  return <p>y</p>\n}\n", "export function Cb() {\n  return <p>x</p>\n}\n"),
    ("TS-REACT-PARALLEL-SIBLING", "function loadUser(id) {\n  return api.get('/user', id).then((r) => r.data)\n}\nfunction loadTeam(key) {\n  return api.get('/team', key).then((q) => q.data)\n}\n", "function loadUser(id) {\n  return api.get('/user', id)\n}\n"),
    ("TS-REACT-RANDOM-KEY", "const A = () => <li key={Math.random()}>x</li>\n", "const A = () => <li key={x.id}>x</li>\n"),
    ("TS-REACT-REPEATED-JSX", "const A = () => <div><p><b>1</b></p><p><b>2</b></p><p><b>3</b></p></div>\n", "const A = () => <div><p><b>1</b></p></div>\n"),
    ("TS-REACT-TOO-MANY-PROPS", "export function Da({ a, b, c, d, e, f, g }) {\n  return <p>x</p>\n}\n", "export function Db({ a }) {\n  return <p>x</p>\n}\n"),
]
FORM = "<form><label><b>x</b></label><p><i>y</i></p></form>"
PLACED = [
    ("TS-XFILE-DUP-COMPONENT", {"a/One.tsx": "export function One({ a }) {\n  const b = useThing(a)\n  return <section><h4>{b}</h4></section>\n}\n", "a/Two.tsx": "export function Two({ c }) {\n  const d = useThing(c)\n  return <section><h4>{d}</h4></section>\n}\n"}, {"b/One.tsx": "export function Solo({ a }) {\n  return <h5>{a}</h5>\n}\n"}),
    ("TS-XFILE-DUP-FUNCTION", {"c/a.ts": "function one(a) {\n  const b = go(a)\n  const c = run(b)\n  return c.end()\n}\n", "c/b.ts": "function two(x) {\n  const y = go(x)\n  const z = run(y)\n  return z.end()\n}\n"}, {"d/a.ts": "function lone(a) {\n  const b = hop(a)\n  const c = skip(b)\n  return c.jump()\n}\n"}),
    ("TS-XFILE-DUP-JSX-BLOCK", {"e/A.tsx": f"export const Ae = () => {FORM}\n", "e/B.tsx": f"export const Be = () => <main>{FORM}</main>\n"}, {"f/A.tsx": "export const Af = () => <form><p>x</p></form>\n"}),
]
DESIGN = {"ui_paths": ("@/ui/",), "components": ("Chip",), "primitives": {"Badge": r"\brounded-full\b"}}
DESIGNED = [
    ("TS-DS-DIRECT-UI-IMPORT", "import { Chip } from '@/ui/chip'\n", "import { Chip } from '@/shell'\n"),
    ("TS-DS-INLINE-PRIMITIVE", "const A = () => <span className=\"rounded-full\">x</span>\n", "const A = () => <span className=\"plain\">x</span>\n"),
    ("TS-DS-SIZE-OVERRIDE", "const A = () => <Chip className=\"h-8\" />\n", "const A = () => <Chip size=\"sm\" />\n"),
]
