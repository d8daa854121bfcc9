"""Problem 1: literal credentials in paths and texts, found and redacted.

Literals that could be a credential by their form are the tokens; a linear-chain
conditional random field labels them outside, begin or inside (of a
credential put together from pieces), from their shape and from the words and signs
around them. The Viterbi spans are what is redacted, character for character; a
private key's block is redacted from the marked first line to its last.

The field is trained here on lines made from templates: ``TRAIN_LINES`` of them and ``KEYED_LINES`` of plain literals after a key,
quoted or bare, with a fixed seed, so every run and every machine has the same model.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.crf import Crf, slot

#: Made lines the model is trained on, and their seed.
TRAIN_LINES, KEYED_LINES, SEED = 9000, 6000, 11
MARK = "REDACTED"
O, B, I = 0, 1, 2  # noqa: E741

# Published forms of access tokens.
TOKEN_FORMS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{5,}|AIza[\w-]{5,}|gh[pousr]_[A-Za-z0-9]{4,}|github_pat_\w{8,}|glpat-[\w-]{3,}|[sr]k_(?:live|test)_[A-Za-z0-9]{1,}"
    r"|npm_[A-Za-z0-9]{4,}|hvs[.-][\w-]{7,}|SG[.-][\w-]{6,}(?:[.-][\w-]{6,})?|xox[abeprs]-[\w-]{6,}|eyJ[\w-]{8,}(?:\.[\w-]+){0,2}"
)
_WORD = r"[\w+/!#%*&^~.-]"
_TOKEN = re.compile(
    rf"(?P<form>(?<![A-Za-z0-9])(?:{TOKEN_FORMS}))"
    r"|(?P<block>-----BEGIN [A-Z0-9 ]{0,40}(?:KEY|CERTIFICATE|BLOCK)[A-Z ]{0,12}-----)"
    r"|(?P<url>(?<=://)(?P<user>[^\s:/@'\"`<>]*):(?P<pass>[^\s@/'\"`]{2,})(?=@))"
    r"|(?P<quoted>(?P<q>[\"'`])(?=[^\s\"'`]*[A-Za-z])(?P<in>[^\s\"'`;:=,<>{}()\[\]]{3,}={0,2})(?P=q))"
    rf"|(?P<bare>(?<![\w+/!%*&^~.-])(?=[^\s\"'`;:=,<>(){{}}\[\]]*\d)(?=[^\s\"'`;:=,<>(){{}}\[\]]*[A-Za-z]){_WORD}{{6,}}={{0,2}}(?![\w(]))"
    r"|(?P<piece>(?<=[\"'`])[^\s\"'`]{1,40}(?=[\"'`]))"
    r"|(?P<plain>(?<=[=:>] )(?=[^\s]*[a-z])(?=[^\s]*[A-Z+/])[\w+/!#%*&^~-]{7,}={0,2}(?=\s|$))"
)

# Words of names, by what they say of a value.
_SECRET = frozenset("password passwd pwd pass passphrase passwort kennwort secret credential credentials auth clave acceso contrasena passe pw motdepasse geheimnis bearer basic login apikey psk".split())
_KEYED = frozenset("api access signing encryption private service master shared ssh deploy account storage webhook client license".split())
_OTHER = frozenset(
    "digest checksum hash sha sha1 sha256 sha512 md5 crc revision commit integrity id uuid guid trace fingerprint etag version count min max length "
    "limit field pattern file path url host name public cert from ref branch build tag parent mappings rev size expires ttl type".split()
)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z][\w-]*")
# Last words of names whose value is shown to people or checks an entry.
_SHOWN = frozenset("label placeholder hint prompt title text message msg help error regex pattern rule policy class selector input form column header env var lookup provider store manager strength".split())
_PLACE = re.compile(r"(?i)your[-_ ]|replace|change.?me|example|placeholder|dummy|<|todo|xxxx|\*{4}|\.{3}|insert|redacted|vault|kv/|secrets?/|^env")


@lru_cache(maxsize=100_000)
def name_class(name: str) -> str:
    """What a name says of the value after it: secret, token, other or none."""
    parts = [p.lower() for p in _SPLIT.findall(name)]
    if not parts:
        return "none"
    if any(p in _OTHER for p in parts) or parts[-1] in _SHOWN:
        return "other"
    if any(p in _SECRET for p in parts) or (parts[-1] == "key" and any(p in _KEYED for p in parts[:-1])):
        return "secret"
    if parts[-1] in ("token", "tokens"):
        return "token" if len(parts) > 1 else "wordtoken"
    return "none"


@lru_cache(maxsize=100_000)
def shape(s: str) -> str:
    """The form of a literal."""
    core = s.rstrip("=")
    if re.fullmatch(TOKEN_FORMS, s):
        return "form:" + s[:3]
    if s.startswith("-----BEGIN"):
        return "block:private" if "PRIVATE" in s else "block:other"
    if re.fullmatch(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", s):
        return "uuid"
    if re.fullmatch(r"[*xX.•#-]{4,}", s):
        return "mask"
    if re.fullmatch(r"\d{4,}", s):
        return "digits"
    if re.fullmatch(r"\$\w+|\$?\{{1,2}[^{}]*\}{1,2}|%\w+%|<[^<>]*>|\[[^\[\]]*\]|\$\([^()]*\)|[\w.]+[(\[][^()\[\]]*[)\]]", s):
        return "ref"
    if re.match(r"vault:|\w+:(?:kv|secret)/", s):
        return "store"
    if _PLACE.search(s):
        return "place"
    if re.search(r"\s", s):
        return "phrase" if re.fullmatch(r"[a-z]+(?: [a-z]+){2,}", s) else "text"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return f"hex{len(s)}" if len(s) in (32, 40, 48, 56, 64, 128) else f"hex~{min(len(s) // 8, 6)}"
    if re.fullmatch(r"0x[0-9a-fA-F]+|v?\d+(?:\.\d+)+\w*|\d+[a-z]{0,2}", s):
        return "number"
    lower, upper, digit = any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s)
    odd = sum(c in "!#%*&^~+@$" for c in core)
    turns = sum(a.isdigit() != b.isdigit() or (a.islower() and b.isupper()) for a, b in zip(core, core[1:]))
    if len(s) < 12 and re.fullmatch(r"[A-Za-z_$]\w{0,3}(?:[*+%/&|^~-]+\w{1,4})+", s):
        return "arith"
    if re.fullmatch(r"(?:%[-+#0-9.]*[a-zA-Z]|\{\w*\}|[/:,.\-=|()])+", s):
        return "format"
    if re.fullmatch(r"[A-Z][A-Z0-9_]*", s):
        return "CONST"
    if re.fullmatch(r"[A-Z]?[a-z]{3,}[^\w\s]?[_-]?\d{2,}\w{0,3}[!.?#]?", s) and (odd or upper or "_" in s or "-" in s or "." in s):
        return "human"
    if re.fullmatch(r"[a-z]{3,}\d{2,4}[A-Za-z0-9]{3,7}", s):
        return "wordrand"
    if re.search(r"\.(?:py|js|ts|go|java|md|sql|json|ya?ml|toml|xml|sh|example|org|com|html?|txt|map|css)$", s):
        return "file"
    if re.fullmatch(r"[a-z0-9]+(?:[_/.-][a-z0-9]+)*", s):
        return "lowerdigit" if digit and turns > 3 else "name"
    if re.fullmatch(r"[A-Za-z0-9+/]{20,}={0,2}", s) and lower and upper and (digit or s.endswith("=")):
        return f"b64:{min(len(s) // 24, 4)}"
    if lower and upper and digit and (turns >= 3 or odd):
        return "random"
    if odd and (digit or upper):
        return "symbols"
    if re.fullmatch(r"[A-Za-z]+", s) and turns and (turns >= 3 or (len(s) <= 16 and re.search(r"[A-Z]{2}|[a-z][A-Z][a-z]?[A-Z]", s))):
        return "mixed"
    if re.fullmatch(r"[A-Za-z_][\w.]*", s):
        return "camel"
    return "rest"


def _entropy(s: str) -> int:
    n = len(s)
    return int(-sum(v / n * math.log2(v / n) for v in Counter(s).values()) * 2)


_CANDIDATE = ("form", "block", "url", "quoted", "bare", "plain")


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, how it was found) of the literals that could be a credential or a further piece of one."""
    out, pos, last = [], 0, -1
    while m := _TOKEN.search(text, pos):
        how = m.lastgroup if m.lastgroup in _CANDIDATE else "url" if m.group("url") is not None else "quoted" if m.group("quoted") is not None else "piece"
        a, b = m.span("pass") if how == "url" else m.span("in") if how == "quoted" else m.span()
        pos = max(b, m.end()) if how == "quoted" else max(b, pos + 1)
        if how == "piece" and not (last >= 0 and _JOIN.fullmatch(text[last:a])):
            continue
        if how == "bare" and (inner := _FORM.search(text, a, b)):
            a, b, how = *inner.span(), "form"
            pos = b
        if how == "quoted" and not (last >= 0 and _JOIN.fullmatch(text[last:a])):
            s = text[a:b]
            if len(s) > 3 and _JOIN.match(text, b):
                pass  # a first piece may be anything
            elif len(s) < 5 or (not re.search(r"\d", s) and (not re.search(r"[A-Z]", s) or shape(s) == "CONST") and not re.search(r"[!#%*&^~+@$]", s)):
                continue
        if how in ("bare", "plain") and shape(text[a:b]) == "arith":
            continue
        out.append((a, b, how))
        last = b
    return _keyed(text, out)


# A literal right after a key, whatever its signs: in quotes, or bare up to white space or the sign that ends it.
_KEYED_LITERAL = re.compile(
    r"(?P<name>[A-Za-z][\w-]*)(?P<kq>[\"'`]?)\s*(?:\]\s*)?(?::=|=>|=(?![=~>])|:(?!:))[ \t]*(?:(?P<q>[\"'`])(?P<in>(?:(?!(?P=q))[^\\\n]|\\.){3,})(?P=q)|(?P<bare>[^\s\"'`;,(){}\[\]<>$|]{4,})(?=\s|$|[;,\"'`]))"
)


def _keyed(text: str, toks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The tokens with the whole literal of each key of class secret or token; pieces found inside one give way to it."""
    more = []
    for m in _KEYED_LITERAL.finditer(text):
        if name_class(m.group("name")) not in ("secret", "token"):
            continue
        how = "keyed" if m.group("in") is not None else "kbare"
        a, b = m.span("in") if how == "keyed" else m.span("bare")
        more.append((a, b, how))
    if not more:
        return toks
    out, k = [], 0
    for a, b, how in more:  # both lists are in order, so one pass merges them
        while k < len(toks) and toks[k][1] <= a:
            out.append(toks[k])
            k += 1
        inside = []
        while k < len(toks) and toks[k][0] < b:
            inside.append(toks[k])
            k += 1
        if any(x <= a and b <= y or x < a or b < y or h in ("form", "block", "url") for x, y, h in inside) or (out and a < out[-1][1]):
            out += inside
        else:
            out.append((a, b, how))
    return out + toks[k:]


# Endings of files whose bare values are literals, of code, where they are names, and of prose.
_CONF = frozenset("yaml yml env ini cfg conf properties toml sh bash zsh tfvars dockerfile netrc pgpass".split())
_CODE = frozenset("py js mjs cjs jsx ts tsx go java kt rb php rs c h cpp cs scala swift sql".split())
_PROSE = frozenset("md rst txt adoc".split())


@lru_cache(maxsize=10_000)
def format_of(path: str | None) -> str:
    """conf, code, prose, or ``-`` where the path does not tell."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    end = name.rsplit(".", 1)[-1]
    return "conf" if end in _CONF or name.startswith(".env") else "code" if end in _CODE else "prose" if end in _PROSE else "-"


_FORM = re.compile(rf"(?<![A-Za-z0-9])(?:{TOKEN_FORMS})")
_JOIN = re.compile(r"[\"'`]\s*(?:\\|\+|\.|&)?\s*[\"'`]")
_OPENER = re.compile(r"(?:[(=:|>+\\]|>-|\|-)\s*$")


_SEPARATOR = re.compile(r"(\s?)(:=|=>|=|:)(\s?)[\"'`]?$")


def features(text: str, toks: list[tuple[int, int, str]], fmt: str = "-") -> list[list[int]]:
    """The feature slots of each token; ``fmt`` is the text's format, which tells whether bare values are literals or names."""
    out, before = [], -1
    for a, b, how in toks:
        s = text[a:b]
        kind = shape(s)
        begin = text.rfind("\n", 0, a) + 1
        left = text[max(begin, a - 120) : a]
        end = text.find("\n", b)
        right = text[b : min(len(text) if end < 0 else end, b + 60)]
        names = [n for n in _NAME.findall(left)][-6:]
        key, dist = "none", 0
        for d, n in enumerate(reversed(names)):
            c = name_class(n)
            if c != "none":
                key, dist = c, d
                break
        if how == "url":
            key, dist = "secret", 0
        above = "-"
        if key in ("none", "wordtoken") and (not left.strip(" \t\"'`(+-#") or [n.lower() for n in names] in (["value"], ["string"], ["string", "value"])):
            prev = text[max(0, text.rfind("\n", 0, max(begin - 1, 0)) + 1, begin - 160) : max(begin - 1, 0)].rstrip("\r")
            if _OPENER.search(prev) or prev.rstrip().endswith((":", "=", "(")):
                cs = [c for c in map(name_class, _NAME.findall(prev)[-3:]) if c != "none"]
                above = cs[-1] if cs else "open"
            elif pm := re.search(r"(?i)(?:<(?:key|name)>\s*|\bname[\"']?\s*[:=]\s*[\"']?)([\w-]+)\s*(?:</\w+>|[\"']?,?)\s*$", prev):
                above = name_class(pm.group(1))
        note = "-"
        if cm := re.search(r"(?://|#|--|/\*|<!--)\s*([A-Za-z][\w-]*)\s*(?:\*/|-->)?\s*$", right):
            note = name_class(cm.group(1))
        l1 = left[-1:] or "^"
        gap = left.rstrip(" \"'`")[-1:] or "^"
        r1 = right[:1] or "$"
        word = names[-1].lower() if names else "-"
        lead = word if word in ("bearer", "basic", "values", "sha256", "sha512", "md5", "input", "env", "from", "u", "with", "commit", "getenv", "get") else "-"
        join = "-"
        if before >= 0:
            between = text[before:a]
            join = "join" if len(between) < 40 and _JOIN.fullmatch(between) else "near" if "\n" not in between else "far"
        got = "k" if key in ("secret", "token") or above in ("secret", "token") or note in ("secret", "token") else "o" if "other" in (key, above, note) else "n"
        size, ent = min(len(s) // 6, 8), _entropy(s)
        fs = [
            "b", f"s={kind}", f"how={how}", f"len={size}", f"ent={ent}", f"key={key}", f"key={key}/{min(dist, 3)}", f"above={above}", f"note={note}",
            f"l={l1}", f"r={r1}", f"gap={gap}", f"lead={lead}", f"join={join}", f"s={kind}|got={got}", f"s={kind}|key={key}", f"s={kind}|l={l1}|r={r1}",
            f"got={got}|ent={ent}", f"got={got}|len={size}", f"how={how}|got={got}", f"s={kind}|lead={lead}", f"s={kind}|how={how}", f"join={join}|got={got}",
            f"s={kind.split(':')[0]}|above={above}", f"head={text[begin:a].lstrip()[:2]}", f"got={got}|gap={gap}",
        ]
        if how in ("keyed", "kbare") or (key in ("secret", "token") and len(s) < 12 and not how == "url"):
            m = _SEPARATOR.search(left)
            sep = "".join(("_" if m.group(1) else "", m.group(2), "_" if m.group(3) else "")) if m else "-"
            name = next((n for n in reversed(names) if name_class(n) in ("secret", "token")), "")
            case = "up" if name.isupper() else "low"
            q = left[-1:] in "\"'`" and left[-1:] != ""
            whole = left.strip() == "" or re.fullmatch(r"\W*(?:export\s+|set\s+|ENV\s+|-\s+)?[\w.-]+[\"'`]?\s*(?::=|=>|=|:)\s*[\"'`]?", left) is not None
            end_ = right.strip()[:1] or "$"
            sort = "dotted" if re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+", s) else "snake" if re.fullmatch(r"[a-z]+(?:_[a-z]+)+|[a-z]+[A-Z]\w*", s) else "word" if s.isalpha() and s.islower() else "Word" if s.isalpha() else "num" if s.isdigit() else "mix"
            fs += [
                f"k:sep={sep}|q={q}", f"k:fmt={fmt}|sep={sep}|q={q}|whole={whole}", f"k:fmt={fmt}|q={q}|sort={sort}", f"k:q={q}|sep={sep}|sort={sort}|whole={whole}", f"k:case={case}|sep={sep}|sort={sort}|q={q}",
                f"k:fmt={fmt}|sort={sort}|sep={sep}|q={q}|end={end_}", f"k:w={s.lower()}" if len(s) < 24 else "k:long", f"k:kind={kind}|q={q}|fmt={fmt}", f"k:words={min(s.count(' '), 4)}|digit={any(c.isdigit() for c in s)}|q={q}",
                f"k:last={(_SPLIT.findall(name) or ['-'])[-1].lower()}|sort={sort}|q={q}", f"k:open={left.lstrip()[:1] in '-*#>' and '`' in left}|fmt={fmt}",
                f"k:same={name.lower() in s.lower() or s.lower() in name.lower()}|q={q}", f"k:has={any(p in _SECRET or p in ('token', 'key') for p in (x.lower() for x in _SPLIT.findall(s)))}|q={q}",
            ]
        out.append([slot(f) for f in fs])
        before = b
    return out


# ---------------------------------------------------------------- training lines


def _training(n: int, seed: int):
    """(text, credential spans) made from templates: names, forms of value and ways to write them are drawn independently."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    abc = low + up + dig

    def some(chars, k):
        return "".join(r.choice(chars) for _ in range(k))

    def syll(k=2):
        return "".join(r.choice(["ba", "ko", "mer", "tin", "lu", "zan", "dor", "pel", "rin", "sta", "vor", "qui", "nel"]) + r.choice(["", "n", "r", "s"]) for _ in range(k))

    plain = ["parser", "window", "cache", "report", "index", "server", "user", "orders", "stage", "billing", "mail", "queue"]

    def style(words):
        k = r.randrange(4)
        return ["_".join(words), "_".join(words).upper(), words[0] + "".join(w.title() for w in words[1:]), "-".join(words)][k]

    def secret_name():
        w = r.choice([["password"], ["passwd"], ["pwd"], ["api", "key"], ["access", "key"], ["client", "secret"], ["secret"], ["auth", "token"], ["bot", "token"], ["private", "token"],
                      ["signing", "key"], ["encryption", "key"], ["passphrase"], ["service", "credential"], ["db", "password"], ["smtp", "pass"], ["redis", "auth"], ["admin", "pw"],
                      ["passwort"], ["kennwort"], ["clave", "acceso"], ["mot", "de", "passe"], ["webhook", "secret"], ["auth", "password"]])
        return style(([r.choice(plain)] if r.random() < 0.4 else []) + w)

    def other_name():
        w = r.choice([["checksum"], ["digest"], ["revision"], ["commit", "id"], ["trace", "id"], ["key", "id"], ["token", "digest"], ["integrity"], ["request", "id"], ["etag"], ["sha256"], ["build", "hash"], ["public", "key"], ["password", "hash"]])
        return style(([r.choice(plain)] if r.random() < 0.3 else []) + w)

    def neutral_name():
        return style([r.choice(plain + ["value", "handle", "remote", "extra", "opts", "x1", "arg", "ref", "marker", "client" + some(dig, 2)])])

    def form():
        return r.choice([
            lambda: "AKIA" + some(up + dig, 16), lambda: "AIza" + some(abc + "-_", 35), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(abc, 36), lambda: "glpat-" + some(abc, 20),
            lambda: "sk_live_" + some(abc, 24), lambda: "npm_" + some(abc, 36), lambda: "hvs." + some(abc, r.choice([20, 24])), lambda: "SG." + some(abc + "-_", 22) + "." + some(abc + "-_", 43),
            lambda: f"xoxb-{some(dig, 11)}-{some(dig, 12)}-{some(abc, 24)}", lambda: f"eyJ{some(abc, 33)}.{some(abc, 40)}.{some(abc + '-_', 43)}",
        ])()

    def hexa():
        return some(dig + "abcdef", r.choice([32, 40, 48, 64]))

    def free():
        return r.choice([
            hexa, lambda: some(abc + "+/", r.choice([40, 42, 43])) + r.choice(["", "=", "=="]), lambda: some(abc + "!#%*&_-", r.randint(14, 21)),
            lambda: syll().title() + r.choice("!#%+-_.") + some(dig, 4) + r.choice(["", "!", r.choice(low)]), lambda: syll() + some(dig, 3) + some(abc, 4),
        ])()

    def value():
        return form() if r.random() < 0.4 else free()

    def dummy(name):
        up_ = re.sub(r"(?<=[a-z])(?=[A-Z])|-", "_", name).upper()
        return r.choice(["************", "xxxxxxxxxxxxxxxxxxxx", "REPLACE_ME", "changeme", f"<your-{name.lower()}>", f"[your-{name.lower()}]", "${" + up_ + "}", f"vault:kv/{r.choice(plain)}#{name}", "{{ " + up_ + " }}", "...", "your-key-here", "$" + up_, "%" + up_ + "%", "example"])

    def ident():
        return r.choice([hexa, lambda: "sha256:" + some(dig + "abcdef", 64), lambda: f"sha512-{some(abc + '+/', 86)}==", lambda: "-".join(some(dig + "abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: some(dig + "abcdef", 16)])()

    ways = [  # name and value in one line; {n} and {v} stand once each
        '{n} = "{v}"', "{n} = '{v}'", "const {n} = '{v}';", 'var {n} = "{v}"', '\t{n} = "{v}"', '    String {n} = "{v}";', '    private static final String {n} = "{v}";', '  "{n}": "{v}",', "  '{n}': '{v}',",
        "{n}: {v}", "{n}: '{v}'", '  {n}: "{v}"', "{n}={v}", "export {n}={v}", "#{n}={v}", '  <add key="{n}" value="{v}"/>', "  <{n}>{v}</{n2}>", "  <!-- {n}: {v} -->", "// {n} -> {v}", "// {n}: {v}", "# old access: {n} {v}",
        "# temporary login: {n} {v}", "# works on staging: {n} {v}", "Log in as `svc` with the {n} `{v}` until the rollout is done.", "Set `{n}` to your own value, for example `{v}`.", 'client = connect("{w}-1.internal.example", {n}=\'{v}\', retries=3)',
        'assert os.environ.get("{n}", "{v}")', 'config.set("{n}", "{v}")', "  {n}: `{v}`,", '    "{n}": \'{v}\',', '{n}.key = {v}', 'os.Setenv("{n}", "{v}")', "{n} := \"{v}\"", "user, {n} = \"svc\", \"{v}\"", "{n} {v}", "insert into settings values ('{n}', '{v}');", "--{n}={v}", "--{n} {v} --retries 3",
    ]
    marked = ['HEADERS = {{"Authorization": "Bearer {v}"}}', "const auth = {{ headers: {{ Authorization: 'Basic {v}' }} }};", 'curl -H "Authorization: Bearer {v}" https://{w}-1.internal.example/v1', "curl -u loader:{v} https://{w}-2.internal.example/status",
              "alter role {w} with login password '{v}';", "create user {w} identified by '{v}';", '    String conn = "Server={w}-2.internal.example;User=svc;Pwd={v};";', "machine {w}.example login svc password {v}"]
    dsn = ["{s}://{u}:{v}@{w}-3.internal.example/app", "{s}://{u}:{v}@{w}-3.internal.example:5432/app"]
    around = ['DSN = "{x}"', "dsn: {x}", "broker: {x}", "-- dsn {x}", "const dsn = '{x}';", 'DSN={x}', '  "dsn": "{x}",', 'var dsn = "{x}"', "git clone {x}", "see {x} for details"]
    noise = [  # lines with literals that are none
        lambda: f"insert into {r.choice(plain)} values ({some(dig, 2)}, '{r.choice(plain + ['token'])}', {some(dig, 4)}, '{some(dig + 'abcdef', 16)}');", lambda: f"    \"integrity\": \"sha512-{some(abc + '+/', 86)}==\"", lambda: f"{r.choice(plain).upper()}_{r.choice(plain).upper()}={some(dig, 3)}",
        lambda: f"password_min_length = {some(dig, 2)}", lambda: "const passwordField = 'input[name=password]';", lambda: "alter role reader with password :'reader_pw';", lambda: f"{secret_name()}_from: secrets/{r.choice(plain)}",
        lambda: f'{secret_name()} = os.environ["{secret_name().upper()}"]', lambda: f"const {secret_name()} = process.env.{secret_name().upper()};", lambda: f"{secret_name()} = getpass()", lambda: f"# see commit {hexa()} and {some(dig + 'abcdef', 8)}",
        lambda: f"token_count = {some(dig, 4)}", lambda: f"version = \"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}\"", lambda: f"const {r.choice(plain)} = '{some(abc + '+/', 200)}';", lambda: f"  {', '.join('0x' + some(dig + 'abcdef', 2) for _ in range(12))},",
        lambda: f"import {{ load2 }} from '../{r.choice(plain)}/{r.choice(plain)}{r.randint(1, 9)}.js';", lambda: f"var q{some(low, 1)}={some(dig, 4)},a{some(low, 1)}2=[{some(dig, 2)},{some(dig, 2)}];if(\"{r.choice(plain)}\"===typeof {some(low, 2)})throw new Error(\"{some(abc, 3)}\");",
        lambda: f'"mappings": "{";".join(some(up, 4) for _ in range(20))}"', lambda: f"Seit {r.randint(1, 9)}.1.7 werden {some(dig, 2)} Einträge aus src/{r.choice(plain)}_00x{some(dig, 3)}.py gelesen", lambda: f"for i in range(32): h264 = utf8(x{r.randint(1, 9)}, md5)", lambda: f"return fmt.Sprintf(\"{r.choice(['%s/%d', '%s:%d', '%v-%s', '%-8s|%5d', '{}/{}', '%Y-%m-%d'])}\", t.Name, t.Count)", lambda: f"fmt.Errorf(\"late token: %q\", path{r.randint(1, 9)})",
        lambda: f"-----BEGIN PUBLIC KEY-----\n{some(abc + '+/', 64)}\n-----END PUBLIC KEY-----", lambda: f"-----BEGIN CERTIFICATE-----\n{some(abc + '+/', 64)}\n-----END CERTIFICATE-----", lambda: f"{neutral_name()} = \"{ident()}\"", lambda: f"{neutral_name()}: {some(abc + '+/', 43)}=", lambda: f"docs/{r.choice(plain)}/{some(low, 6)}-{some(dig + 'abcdef', 6)}.min.js",
        lambda: f"ssh-rsa AAAAB3NzaC1yc2E{some(abc + '+/', 80)} {r.choice(plain)}@host.example", lambda: f"https://loader@{r.choice(plain)}-5.internal.example/app", lambda: f"dbConnect('{r.choice(plain)}Db', 'utf8mb4', 'readOnly{r.randint(1, 9)}')", lambda: f"assert parse('{r.choice(plain).title()}{r.choice(plain).title()}') == '{r.choice(plain)}V{r.randint(1, 9)}'",
    ]

    def fill(way, **kw):
        text = way.format(n2=kw.get("n", ""), w=r.choice(plain), **kw)
        return text, kw.get("v")

    made = []
    while len(made) < n:
        k = r.random()
        if k < 0.30:
            text, v = fill(r.choice(ways), n=secret_name(), v=value())
        elif k < 0.36:
            text, v = fill(r.choice(ways), n=neutral_name(), v=form())
        elif k < 0.43:
            text, v = fill(r.choice(marked), v=value() if r.random() < 0.85 else (v0 := dummy("token")))
            if "REPLACE" in text or re.search(r"\*{4}|xxxx|your|\$|vault|\{\{|%[A-Z]|changeme|example['\"]|\.\.\.", text):
                v = None
        elif k < 0.51:
            good = r.random() < 0.55
            p = free().replace("/", "x").replace("#", "x") if good else r.choice(["****", "<password>", "${DB_PASS}", "$PASS", "********", "{password}", "PASSWORD"])
            url = r.choice(dsn).format(s=r.choice(["redis", "amqp", "postgresql", "mysql", "mongodb", "https"]), u=r.choice(["svc", "root", "", "loader"]), v=p, w=r.choice(plain))
            text, v = r.choice(around).format(x=url), p if good else None
        elif k < 0.61:
            name = secret_name()
            text, v = fill(r.choice(ways), n=name, v=dummy(name))[0], None
        elif k < 0.70:
            text, v = fill(r.choice(ways), n=other_name(), v=ident())[0], None
        elif k < 0.73:
            kind = r.choice(["RSA PRIVATE", "PRIVATE", "EC PRIVATE", "OPENSSH PRIVATE", "ENCRYPTED PRIVATE"])
            v = f"-----BEGIN {kind} KEY-----"
            text = r.choice(["", "const k = `\n", "key: |\n  ", 'KEY = """\n']) + v + "\n" + some(abc + "+/", 64)
        elif k < 0.79:
            name, whole = secret_name(), value()
            cut = r.randint(min(5, len(whole) - 2), max(5, min(11, len(whole) - 1)))
            one, two = whole[:cut], whole[cut:]
            q = r.choice("'\"")
            text = r.choice(["{n} = (\n    {q}{a}{q}\n    {q}{b}{q}\n)", "const {n} = {q}{a}{q} +\n  {q}{b}{q};", "    String {n} = {q}{a}{q}\n        + {q}{b}{q};", "{n} = {q}{a}{q} \\\n    {q}{b}{q}", "const {n} = {q}{a}{q} + {q}{b}{q};", "{n} = ( {q}{a}{q} {q}{b}{q} )"]).format(n=name, q=q, a=one, b=two)
            at = text.index(q + one + q) + 1
            at2 = text.index(q + two + q, at) + 1
            made.append((text, [(at, at + len(one), B), (at2, at2 + len(two), I)]))
            continue
        elif k < 0.83:
            text, v = r.choice(["{n}: |\n  {v}", "{n}: >-\n    {v}", "{n} =\n    {v}", '      - name: {n}\n        value: "{v}"', '    "name": "{n}",\n    "value": "{v}"', "  <name>{n}</name>\n  <value>{v}</value>", "<key>{n}</key>\n  <string>{v}</string>", "{n}:\n  {v}"]).format(n=secret_name(), v=(v := value())), v
        elif k < 0.84:
            text, v = r.choice(["{n}: |\n  {v}", '      - name: {n}\n        value: "{v}"', '    "name": "{n}",\n    "value": "{v}"', "{n} = (\n    '{v}'\n)"]).format(n=r.choice([other_name, neutral_name])(), v=ident()), None
        elif k < 0.87:
            v = form() if r.random() < 0.8 else hexa()
            text = r.choice(["const client{k} = \"{v}\"; // {n}", "x{k} = '{v}'  # {n}", "var c{k} = \"{v}\" // {n}"]).format(k=some(dig, 2), v=v, n=secret_name())
        elif k < 0.88:
            v = re.sub(r"\.", "-", form())
            if v.startswith(("eyJ", "xox")):
                continue
            text = f"{r.choice(plain)}/{r.choice(plain)}/{r.choice(plain)}_{r.choice(plain)}_{v}.{r.choice(['py', 'go', 'ts', 'yaml'])}"
        else:
            text, v = r.choice(noise)(), None
        if r.random() < 0.25:  # as in a preview: other lines before and after, all white space collapsed
            text = " ".join(f"{r.choice(noise)()} {text} {r.choice(noise)()}".split()) if "\n" not in text or r.random() < 0.5 else " ".join(text.split())
        if v is not None and v not in text:
            continue
        made.append((text, [(text.rindex(v), text.rindex(v) + len(v), B)] if v is not None else []))
    return made


def _training_keyed(n: int, seed: int):
    """(text, credential spans, format) of literals right after a key whose signs say little: words, digits, phrases and odd
    signs, in quotes or bare. Bare words are credentials in settings and names in code; words that say what a field is are none."""
    r = random.Random(seed)
    nouns = ["horse", "battery", "staple", "river", "copper", "winter", "garden", "silver", "monkey", "dragon", "summer", "coffee", "rocket", "purple", "tiger", "castle", "orange", "thunder", "pickle", "anchor"]
    names = ["password", "db_password", "DB_PASSWORD", "passwd", "adminPassword", "pwd", "passphrase", "secret", "clientSecret", "client_secret", "smtp_pass", "kennwort", "api_key", "apiKey", "authToken", "webhook_secret", "signing_key", "PASSWORD", "MYSQL_PASS", "API_SECRET"]
    ways = ['{n} = "{v}"', "{n} = '{v}'", "const {n} = '{v}';", '  "{n}": "{v}",', "  {n}: '{v}'", '{n}: "{v}"', '{n} := "{v}"', '    String {n} = "{v}";', "connect(host, {n}='{v}')", '{n}="{v}"']
    bare = ["{n}={v}", "export {n}={v}", "{n}: {v}", "  {n}: {v}", "set {n}={v}", "ENV {n}={v}", "    - {n}: {v}"]
    code = ["{n} = {v}", "{n} = {v};", "const {n} = {v};", "connect(host, {n}={v})", "    {n}: {v},", "    {n}={v},", "self.{n} = {v}", "def open({n}: {v}):", "    {n}: {v}", "  {n}: {v};", "return {{ {n}: {v} }}", "function go({n}: {v}) {{"]
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    digits = lambda k: pick("0123456789", k)

    def made_word():
        return "".join(pick("bcdfghklmnprstvwz", 1) + pick("aeiou", 1) + r.choice(["", "", pick("lmnrst", 1)]) for _ in range(r.randint(2, 4)))

    def word():
        return r.choice(nouns) if r.random() < 0.4 else made_word()

    def leet():
        return word().replace(r.choice("eaio"), r.choice("3410"))

    odd = lambda: "".join(word()[: r.randint(2, 4)] + r.choice(";:,<>{}()[]=!?&|@") + r.choice(["", digits(2)]) for _ in range(r.randint(2, 4)))
    good = [word, lambda: word() + word(), lambda: word() + word() + word(), lambda: digits(r.randint(4, 12)), lambda: " ".join(word() for _ in range(r.randint(3, 5))), odd, lambda: word().title() + " " + word() + digits(2) + r.choice("!;:,"),
            lambda: " ".join(r.choice([leet, word, lambda: r.choice(["pass", "my", "secret", "phrase", "p4ss"])])() for _ in range(r.randint(2, 4))) + " " + digits(2), lambda: word() + digits(r.randint(1, 4)), lambda: word().title() + "@" + digits(2), leet]
    plain_good = [word, word, lambda: word() + word(), lambda: word() + digits(r.randint(1, 4)), lambda: word().title() + digits(2), leet, lambda: digits(r.randint(4, 10)), lambda: word() + r.choice("!@#%") + digits(2)]
    refs = ["string", "password", "required", "hidden", "basic", "bearer", "none", "null", "true", "default", "optional", "text", "admin-secret", "db_password", "settings.password", "process.env.SECRET", "input[name=password]", "#password", "Enter your password",
            "Password", "Your password", "password must not be empty", "The password is too short", "Please enter the password.", "Passwort eingeben", "wrong password for %s", "a secret of the store", "read from the store", "see the vault", "{{ password }}", "${PASS}", "<your password>",
            "<password>", "{password}", "%s:%s", "Missing token: %s", "no token, no access", "utf-8", "sha256", "form-control", "/run/keys/db", "auth/login", "token", "login", "******** ********", "changeme", "(none)", "[hidden]", "<hidden>", "{}", "[...]", "os.environ['PASS']", "getenv(PASS)"]
    types = ["string", "str", "String", "None", "null", "nil", "undefined", "True", "False", "true", "false", "required", "optional", "hidden", "String!", "bytes", "Optional", "self", "this", "any", "unknown", "secret", "password", "token", "changeme", "REDACTED", "redacted", "masked", "xxxx", "xxxxxxxx", "********", "TODO", "none", "number", "boolean", "Secret", "text", "varchar", "value", "input", "file", "env", "vault", "stdin", "prompt", "external", "disabled", "enabled", "default", "empty", "see", "the"]
    parts = ["user", "config", "settings", "opts", "args", "self", "this", "req.body", "env", "ctx", "form", "cfg", "process.env", "os.environ", "secrets", "params", "props", "store", "next", "new", "old", "read", "load", "get"]
    made = []
    while len(made) < n:
        name, k, fmt = r.choice(names), r.random(), r.choice(["-", "conf", "code", "prose"])
        hit = True
        if r.random() < 0.03:
            name = f"{r.choice(nouns)}_{r.choice(nouns)}_{r.choice(['pw', 'pw', 'token'])}"
            v, hit = r.choice([word, lambda: digits(r.randint(3, 4))])(), False
            way = r.choice(['  "{n}": "{v}",', "{n}: {v}", "  {n}: {v}"] if name.endswith("pw") else ["- `{n}`: {v} every query at most once", "* `{n}`: {v} a list", "`{n}`: {v} the next one"])
        elif k < 0.32:
            v, way = r.choice(good)(), r.choice(ways)
        elif k < 0.50:
            v, way, fmt = r.choice(plain_good)(), r.choice(bare), r.choice(["conf", "conf", "conf", "-", "prose"])
        elif k < 0.54:
            v, way, fmt = r.choice(plain_good)(), r.choice(["{n} = {v}", "  {n} = {v}"]), "conf"
        elif k < 0.78:
            upper = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).upper()
            own = [f"${{{upper}}}", f"${{{r.choice(nouns).upper()}_{upper}}}", "${" + name + "}", "$" + upper, "{{ " + upper + " }}", f"%{upper}%", f"vault:kv/{r.choice(nouns)}#{name}", f"vault:kv/{r.choice(nouns)}#{r.choice(nouns)}_{name}", f"<your-{name}>", f"[your-{name}]", "*" * 12, "x" * 20]
            v, way, hit = r.choice(own if r.random() < 0.5 else refs), r.choice(ways), False
        elif k < 0.84:
            v, way, hit = r.choice(types), r.choice(bare + code), False
        elif k < 0.96:
            v = r.choice([lambda: f"{r.choice(parts)}.{name}", lambda: f"{r.choice(parts)}.{r.choice(parts)}.{r.choice(nouns)}", lambda: f"{r.choice(parts)}_{name}", lambda: f"{r.choice(parts)}{name.title()}", lambda: name, lambda: r.choice(nouns), made_word, lambda: f"{word()}_{word()}", lambda: word() + word().title(), lambda: name + digits(1)])()
            way, fmt, hit = r.choice(code), r.choice(["code", "code", "-"]), False
            if fmt == "-" and v.isalpha() and v.islower() and way in ("{n} = {v}", "    {n}: {v}"):
                fmt = "code"
        elif k < 0.98:
            v, way, fmt, hit = r.choice([f"secrets/{r.choice(nouns)}", f"{r.choice(nouns)}-{name}", f"{name}_{r.choice(nouns)}", f"/run/secrets/{r.choice(nouns)}", f"file:/etc/{r.choice(nouns)}"]), r.choice(bare), "conf", False
        else:
            name, v, way, hit = r.choice(["pw", "pass", "aw", "pwd"]), digits(4), r.choice(["var ab=12,{n}={v},c3=[1,2];", ");let lv=1558,{n}={v},q=1", "function(){{var {n}={v};return {n}}}"]), False
        text = way.format(n=name, v=v)
        at = text.index(v, text.index(name) + len(name))
        made.append((text, [(at, at + len(v), B)] if hit else [], fmt))
    return made


@lru_cache(maxsize=1)
def model() -> Crf:
    """The trained field, made once in a process."""
    chains = []
    for text, spans, *fmt in [*_training(TRAIN_LINES, SEED), *_training_keyed(KEYED_LINES, SEED)]:
        toks = tokens(text)
        if not toks:
            continue
        labels = [next((lab for x, y, lab in spans if a < y and x < b and min(b, y) - max(a, x) >= 0.6 * (b - a)), O) for a, b, _ in toks]
        chains.append((features(text, toks, *fmt), labels))
    return Crf(3).fit(chains, epochs=6, rate=0.25, l2=1e-5, seed=SEED)


_END = re.compile(r"-----END [A-Z0-9 ]*-----")
_BODY = re.compile(r"(?:[\s\\nr\"'+,`]*(?:[A-Za-z0-9+/=]{16,}|[A-Z][A-Za-z-]+: [^\n\\]*))*")


def block_end(text: str, at: int) -> int:
    """Where the key block whose begin mark ends at ``at`` ends: after its end mark, however far, unless another block begins before; else after the lines that look like a key's."""
    m, other = _END.search(text, at), text.find("-----BEGIN ", at)
    if m and (other < 0 or m.start() < other):
        return m.end()
    return at + len(_BODY.match(text, at).group())


def spans(text: str, crf: Crf, fmt: str = "-") -> list[tuple[int, int, bool]]:
    """(start, end, begins a credential) of the Viterbi spans of a text."""
    toks = tokens(text)
    if not toks:
        return []
    joins = [False] + [bool(_JOIN.fullmatch(text[x[1] : y[0]])) for x, y in zip(toks, toks[1:])]
    out, chain = [], crf.viterbi(features(text, toks, fmt), joins)
    until = -1
    for (a, b, how), label in zip(toks, chain):
        if label == O or a < until:
            continue
        if how == "block":
            b = block_end(text, b)
        begins = label == B or not out
        out.append((a, b, begins))
        until = b
    return out


def redact(text: str, found: list[tuple[int, int, bool]]) -> str:
    """The text with each span replaced; line ends inside a span stay, so every line keeps its number."""
    out, pos = [], 0
    for a, b, _ in found:
        out += [text[pos:a], MARK, "\n" * text.count("\n", a, b)] if "\n" in text[a:b] else [text[pos:a], MARK]
        pos = b
    return "".join([*out, text[pos:]])


def _path(df: DataFrame):
    return (F.col("rel_path") if "rel_path" in df.columns else F.lit(None).cast("string")).alias("path")


def _texts(files: DataFrame, contents: DataFrame, chunks: DataFrame) -> DataFrame:
    def part(df, origin, key, col):
        return df.select(F.lit(origin).alias("origin"), F.col(key).alias("record_id"), F.col(col).alias("text"), _path(df))

    return (
        part(files, "rel_path", "file_id", "rel_path").distinct()
        .unionByName(part(files, "content_hint", "file_id", "content_hint"))
        .unionByName(part(contents, "content", "file_id", "content"))
        .unionByName(part(chunks, "chunk_text_preview", "chunk_id", "chunk_text_preview"))
    )


def label(texts: DataFrame) -> DataFrame:
    """(origin, record_id, start, end, line_no, begins) of every credential span in (origin, record_id, text, path) rows.

    Null and empty texts have none. Rows that repeat give repeated results.
    """
    crf = model()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for origin, rid, text, path in zip(b["origin"], b["record_id"], b["text"], b["path"]):
                lines = origin not in ("rel_path", "chunk_text_preview")
                rows += [(origin, rid, a, e, text.count("\n", 0, a) + 1 if lines else 1, first) for a, e, first in spans(text, crf, format_of(path))]
            yield pd.DataFrame(rows, columns=["origin", "record_id", "start", "end", "line_no", "begins"])

    return texts.mapInPandas(work, "origin string, record_id string, start int, end int, line_no int, begins boolean")


def found(files: DataFrame, contents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(origin, record_id, line_no): each line in which a credential begins, once."""
    return label(_texts(files, contents, chunks).filter(F.length("text") > 0)).filter("begins").select("origin", "record_id", "line_no").distinct()


def redacted_texts(files: DataFrame, contents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(origin, record_id, text, spans): each text of the four origins with only the credentials replaced; null and empty texts stay as they are."""
    return _redacted(_texts(files, contents, chunks))


def redacted(contents: DataFrame) -> DataFrame:
    """(file_id, content, spans): the same for the texts of ``contents`` alone."""
    texts = contents.select(F.lit("content").alias("origin"), F.col("file_id").alias("record_id"), F.col("content").alias("text"), _path(contents))
    return _redacted(texts).select(F.col("record_id").alias("file_id"), F.col("text").alias("content"), "spans")


def _redacted(texts: DataFrame) -> DataFrame:
    crf = model()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [spans(t, crf, format_of(p)) if t else [] for t, p in zip(b["text"], b["path"])]
            yield pd.DataFrame({"origin": b["origin"], "record_id": b["record_id"], "text": [redact(t, g) if t else t for t, g in zip(b["text"], got)], "spans": [len(g) for g in got]})

    return texts.distinct().mapInPandas(work, "origin string, record_id string, text string, spans int")
