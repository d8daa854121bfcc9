"""Lexers of nine languages: text to tokens for the grammars of ``grammars``.

``lex(language, text)`` gives (kinds, offsets, line starts) or raises ``LexError``
with the offset at which no token begins and the reason.
"""

from __future__ import annotations

import re
import unicodedata


class LexError(ValueError):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


def _words(text: str) -> frozenset:
    return frozenset(text.split())


PY_KEYWORDS = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield"
)
PY_SOFT = _words("match case type _")
JS_RESERVED = _words(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with"
)
JS_SOFT = _words(
    "async await of get set static as from let yield type interface namespace module declare abstract readonly public private protected "
    "override keyof infer is asserts unique satisfies accessor global out implements package target meta constructor "
    "any unknown never string number boolean symbol object undefined bigint require"
)
GO_KEYWORDS = _words(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select "
    "struct switch type var"
)
JAVA_KEYWORDS = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for "
    "goto if implements import instanceof int interface long native new package private protected public return short static strictfp "
    "super switch synchronized this throw throws transient try void volatile while true false null"
)
JAVA_SOFT = _words("var record sealed permits yield non module open when")


def _ident_ok(s: str) -> bool:
    return s.isidentifier()


# ---------------------------------------------------------------- JSON

_JSON = re.compile(
    r'[ \t\n\r]+|(?P<p>[{}\[\]:,])|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|(?P<w>(?:true|false|null)\b)"
)


def lex_json(text: str):
    kinds, at, pos = [], [], 0
    while pos < len(text):
        m = _JSON.match(text, pos)
        if not m:
            raise LexError(pos, "unclosed string" if text[pos] == '"' else "stray character")
        if g := m.lastgroup:
            kinds.append({"s": "STRING", "n": "NUMBER"}.get(g) or m.group())
            at.append(pos)
        pos = m.end()
    return kinds, at, None


# ---------------------------------------------------------------- XML

_XNAME = r"[A-Za-z_:\u00c0-\u02ff\u0370-\u1fff\u3001-\udfff][\w:.\-\u00b7]*"
_XREF = r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+|{name});"
_XBAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_XATTR = re.compile(rf"\s+({_XNAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')")
_XSTART = re.compile(rf"<({_XNAME})")


def lex_xml(text: str):
    """Tags are matched by name here, as names are no part of a token's kind."""
    kinds, at, pos, stack, dtd = [], [], 0, [], False
    if text.startswith("\ufeff"):
        pos = 1
    if bad := _XBAD.search(text):
        raise LexError(bad.start(), "control character")
    first = pos

    def put(kind: str, p: int) -> None:
        kinds.append(kind)
        at.append(p)

    def refs(part: str, p: int) -> None:
        for m in re.finditer("&", part):
            if not re.compile(_XREF.format(name=_XNAME if dtd else "(?!)")).match(part, m.start()):
                raise LexError(p + m.start(), "bad reference")

    while pos < len(text):
        if text[pos] != "<":
            end = text.find("<", pos)
            end = len(text) if end < 0 else end
            part = text[pos:end]
            refs(part, pos)
            if "]]>" in part:
                raise LexError(pos + part.index("]]>"), "stray section end")
            if part.strip(" \t\r\n"):
                put("TEXT", pos + len(part) - len(part.lstrip()))
            pos = end
        elif text.startswith("<!--", pos):
            end = text.find("--", pos + 4)
            if end < 0 or not text.startswith("-->", end):
                raise LexError(pos if end < 0 else end, "unclosed comment" if end < 0 else "double hyphen in comment")
            pos = end + 3
        elif text.startswith("<![CDATA[", pos):
            end = text.find("]]>", pos)
            if end < 0:
                raise LexError(pos, "unclosed section")
            put("TEXT", pos)
            pos = end + 3
        elif text.startswith("<?", pos):
            end = text.find("?>", pos)
            m = re.compile(_XNAME).match(text, pos + 2)
            if end < 0 or not m:
                raise LexError(pos, "unclosed instruction")
            if m.group().lower() == "xml":
                if pos != first or not re.match(r"<\?xml\s+version\s*=\s*([\"'])1\.[0-9]\1(\s+encoding\s*=\s*([\"'])[\w.-]+\3)?(\s+standalone\s*=\s*([\"'])(yes|no)\5)?\s*$", text[pos:end]):
                    raise LexError(pos, "misplaced or bad declaration")
            pos = end + 2
        elif text.startswith("<!DOCTYPE", pos):
            depth, end = 0, pos
            while end < len(text) and (depth or text[end] != ">"):
                depth += {"[": 1, "]": -1}.get(text[end], 0)
                end += 1
            if end == len(text):
                raise LexError(pos, "unclosed doctype")
            dtd = True
            put("DOCTYPE", pos)
            pos = end + 1
        elif text.startswith("</", pos):
            m = re.compile(rf"</({_XNAME})\s*>").match(text, pos)
            if not m:
                raise LexError(pos, "bad end tag")
            if not stack or stack.pop() != m.group(1):
                raise LexError(pos, "mismatched end tag")
            put("CLOSE", pos)
            pos = m.end()
        else:
            m = _XSTART.match(text, pos)
            if not m:
                raise LexError(pos, "bad tag")
            name, here, seen = m.group(1), pos, set()
            pos = m.end()
            while a := _XATTR.match(text, pos):
                if a.group(1) in seen:
                    raise LexError(pos, "repeated attribute")
                seen.add(a.group(1))
                refs(a.group(2), a.start(2))
                pos = a.end()
            e = re.compile(r"\s*(/?)>").match(text, pos)
            if not e:
                raise LexError(pos, "bad tag")
            put("EMPTY" if e.group(1) else "OPEN", here)
            if not e.group(1):
                stack.append(name)
            pos = e.end()
    return kinds, at, None


# ---------------------------------------------------------------- TOML

_TSTR = (
    r'(?P<mb>"""(?:[^\\"\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n)|"{1,2}(?!"))*"{3,5})'
    r"|(?P<ml>'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*'{3,5})"
    r'|(?P<s>"(?!"")(?:[^"\\\n\x00-\x08\x0b-\x1f\x7f]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*")'
    r"|(?P<l>'(?!'')[^'\n\x00-\x08\x0b-\x1f\x7f]*')"
)
_TSPACE = re.compile(r"[ \t]+|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*")
_TKEY = re.compile(_TSTR + r"|(?P<b>[A-Za-z0-9_-]+)|(?P<p>\[\[|\]\]|[\[\].=])")
_TVAL = re.compile(
    _TSTR
    + r"|(?P<d>\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?)(?![\w.:-])"
    r"|(?P<n>[+-]?(?:(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*)(?![\w.:-])"
    r"|(?P<w>(?:true|false)(?![\w-]))|(?P<p>[\[\]{},])"
)


def lex_toml(text: str):
    """Keys and values have different tokens, so the lexer follows the line: key, ``=``, value. Inside
    braces keys come again; inside brackets lines do not end a value. A key may be given once in a table."""
    kinds, at, pos, mode, nest = [], [], 0, "key", []
    defined, table, path, arrays = {}, (), [], {}

    def put(kind, p):
        kinds.append(kind)
        at.append(p)

    line_first = True
    while pos < len(text):
        if m := _TSPACE.match(text, pos):
            pos = m.end()
            continue
        if text.startswith("\n", pos) or text.startswith("\r\n", pos):
            if "{" in nest:
                raise LexError(pos, "line end in an inline table")
            if not nest:
                if kinds and kinds[-1] != "NL":
                    put("NL", pos)
                mode, line_first, path = "key", True, []
            pos += 1 if text[pos] == "\n" else 2
            continue
        m = (_TKEY if mode == "key" else _TVAL).match(text, pos)
        if not m:
            raise LexError(pos, "unclosed string" if text[pos] in "\"'" else "stray character")
        g, s = m.lastgroup, m.group()
        if mode == "key":
            if g in ("mb", "ml"):
                raise LexError(pos, "stray character")
            if g == "p" and s in ("[[", "[") and not line_first:
                raise LexError(pos, "stray character")
            if g == "p":
                put(s, pos)
                if s == "=":
                    mode = "value"
                    if not nest:
                        key = (*table, *path)
                        if key in defined:
                            raise LexError(pos, "key given twice")
                        defined[key] = "value"
                    path = []
                elif s in ("]", "]]"):
                    key = tuple(path)
                    if s == "]]":
                        arrays[key] = arrays.get(key, 0) + 1
                        key = (*key, arrays[key])
                    else:
                        key = tuple(x for i in range(len(key)) for x in ((key[i], arrays[key[: i + 1]]) if key[: i + 1] in arrays else (key[i],)))
                        if defined.get(key):
                            raise LexError(pos, "table given twice")
                        defined[key] = "table"
                    table, path = key, []
            else:
                put("KEY", pos)
                path = [*path, s.strip("\"'")]
        elif g == "p":
            put(s, pos)
            if s in "[{":
                nest.append(s)
                mode = "key" if s == "{" else "value"
            elif s in "]}":
                if not nest:
                    raise LexError(pos, "stray bracket")
                nest.pop()
                mode = "value"
            elif s == "," and nest and nest[-1] == "{":
                mode = "key"
        else:
            put("VALUE", pos)
        if mode == "key" and nest and text.startswith("}", m.end()):
            mode = "value"
        line_first = False
        pos = m.end()
        if mode == "key" and nest and (k := re.compile(r"[ \t]*\}").match(text, pos)):
            pos, mode = k.end() - 1, "value"
    if kinds and kinds[-1] != "NL":
        put("NL", len(text))
    return kinds, at, None


# ---------------------------------------------------------------- YAML

_YDQ = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\r\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_YSQ = re.compile(r"'(?:[^']|'')*'")
_YPROP = re.compile(r"(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(?=[\s,\]}]|$)")
_YPLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#\s])(?!:(?:\s|$)))*", re.M)
_YFPLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?![#\s])(?!:(?:[\s,\[\]{}]|$)))*", re.M)
_YBAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffe\uffff]")


def lex_yaml(text: str):
    """Lines become KEY, '-', VALUE and flow tokens with INDENT and DEDENT around each deeper block."""
    text = text.removeprefix("\ufeff")
    if bad := _YBAD.search(text):
        raise LexError(bad.start(), "control character")
    kinds, at, stack, pos, n = [], [], [-1], 0, len(text)

    def put(kind, p):
        kinds.append(kind)
        at.append(p)

    def entry(col, p):
        while stack[-1] > col:
            stack.pop()
            put("DEDENT", p)
        if stack[-1] < col:
            stack.append(col)
            put("INDENT", p)

    def close(p):
        while stack[-1] >= 0:
            stack.pop()
            put("DEDENT", p)

    def line_end(p):
        e = text.find("\n", p)
        return n if e < 0 else e

    def after(p):
        """Only space and a comment may follow; the offset of the line's end."""
        e = line_end(p)
        rest = text[p:e].rstrip("\r")
        if rest.strip() and not re.match(r"[ \t]+#", rest):
            raise LexError(p + len(rest) - len(rest.lstrip()), "text after a value")
        return e

    def flow(p, parent):
        depth = 0
        while p < n:
            c = text[p]
            if c in " \t\r":
                p += 1
            elif c == "\n":
                p += 1
                if re.compile(r"(?:---|\.\.\.)(?:\s|$)").match(text, p):
                    raise LexError(p, "document end in brackets")
                m = re.compile(r"[ ]*").match(text, p)
                if m.end() < n and text[m.end()] not in "\r\n#\t" and m.end() - p <= parent and text[m.end()] not in "]}":
                    raise LexError(p, "bad indentation in brackets")
            elif c == "#" and text[p - 1] in " \t\n":
                p = line_end(p)
            elif c in "[{":
                put(c, p)
                depth, p = depth + 1, p + 1
            elif c in "]}":
                put(c, p)
                depth, p = depth - 1, p + 1
                if not depth:
                    return p
            elif c == ",":
                put(c, p)
                p += 1
            elif c == ":" and (p + 1 == n or text[p + 1] in " \t\r\n,[]{}" or kinds[-1] == "QUOTED"):
                put(":", p)
                p += 1
            elif c == "?" and p + 1 < n and text[p + 1] in " \t\n":
                put("?", p)
                p += 1
            elif m := (_YDQ.match(text, p) if c == '"' else _YSQ.match(text, p) if c == "'" else None):
                put("QUOTED", p)
                p = m.end()
            elif c in "\"'":
                raise LexError(p, "unclosed string")
            elif c == "*" and (m := re.compile(r"\*[^\s,\[\]{}]+").match(text, p)):
                put("VALUE", p)
                p = m.end()
            elif m := _YPROP.match(text, p):
                put("PROP", p)
                p = m.end()
            elif m := _YFPLAIN.match(text, p):
                if kinds[-1] != "VALUE" or "\n" not in text[at[-1] : p]:
                    put("VALUE", p)
                p = m.end()
            else:
                raise LexError(p, "stray character")
        raise LexError(p, "unclosed bracket")

    def plain_rest(p, parent):
        """Takes the further lines of a plain or quoted value; the offset of the last line's end."""
        while True:
            e = after(p)
            if re.match(r"[ \t]+#", text[p:e]):
                return e
            q = e
            while q < n:
                m = re.compile(r"\n([ \t]*)(\r?)(?=\n|$)").match(text, q)
                if not m or m.end() >= n:
                    break
                q = m.end()
            m = re.compile(r"\n( *)([^\s#])").match(text, q)
            if not m or len(m.group(1)) <= parent or re.match(r"(?:---|\.\.\.)(?:\s|$)", text[q + 1 : q + 5]):
                return e
            start = m.start(2)
            pm = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#\s])(?!:(?:\s|$)))*", re.M).match(text, start)
            if re.compile(r"[ \t]*:(?:\s|$)").match(text, pm.end()):
                raise LexError(start, "key inside a value")
            p = pm.end()

    def block(p, parent):
        """A literal or folded text from its header on; the offset after it."""
        m = re.compile(r"[|>](?:[1-9]?[+-]?|[+-][1-9])(?=\s|$)").match(text, p)
        if not m:
            raise LexError(p, "bad block header")
        e, want = after(m.end()), None
        while e < n:
            s = e + 1
            le = line_end(s)
            line = text[s:le]
            if line.strip():
                ind = len(line) - len(line.lstrip(" "))
                if ind <= max(parent, -1) or (parent < 0 and ind == 0 and re.match(r"---|\.\.\.", line)):
                    break
                if want is not None and ind < want:
                    break
                want = ind if want is None else want
            e = le
        put("VALUE", p)
        return e

    def node(p, parent, inline):
        """The content at p, on its first line; gives the offset of the end of its last line."""
        while m := _YPROP.match(text, p):
            put("PROP", p)
            p = m.end()
            p += len(re.compile(r"[ \t]*").match(text, p).group())
        e = line_end(p)
        if p >= e or text[p] in "\r\n" or (text[p] == "#" and text[p - 1] in " \t"):
            return e
        c = text[p]
        col = p - (text.rfind("\n", 0, p) + 1)
        if c in "|>":
            return block(p, parent)
        if c == "-" and (p + 1 == n or text[p + 1] in " \t\r\n"):
            if inline:
                raise LexError(p, "sequence on a key's line")
            entry(col, p)
            put("-", p)
            q = p + 1 + len(re.compile(r"[ \t]*").match(text, p + 1).group())
            return node(q, col, False)
        if c == "?" and p + 1 < n and text[p + 1] in " \n":
            entry(col, p)
            put("?", p)
            return node(p + 1 + len(re.compile(r"[ ]*").match(text, p + 1).group()), col, False)
        q = None
        if c in "\"'":
            m = (_YDQ if c == '"' else _YSQ).match(text, p)
            if not m:
                raise LexError(p, "unclosed string")
            q = m.end()
        elif c in "[{":
            if not inline:
                entry(col, p)
            q = flow(p, parent)
            if re.compile(r"[ \t]*:(?:\s|$)").match(text, q):
                raise LexError(q, "brackets as a key")
            return after(q)
        elif c == "*":
            m = re.compile(r"\*[^\s,\[\]{}]+").match(text, p)
            if not m:
                raise LexError(p, "bad alias")
            q = m.end()
        else:
            m = _YPLAIN.match(text, p)
            if not m:
                raise LexError(p, "tab in indentation" if c == "\t" else "stray character")
            q = m.end()
        k = re.compile(r"[ \t]*:(?=\s|$)").match(text, q)
        if k:
            if inline or "\n" in text[p:q]:
                raise LexError(k.start(), "key inside a value")
            entry(col, p)
            put("KEY", p)
            r = k.end() + len(re.compile(r"[ \t]*").match(text, k.end()).group())
            return node(r, col, True)
        if not inline:
            entry(col, p)
        put("VALUE", p)
        if c in "\"'*":
            return after(q)
        return plain_rest(q, parent)

    while pos < n:
        e = line_end(pos)
        line = text[pos:e].rstrip("\r")
        body = line.lstrip(" ")
        if not line.strip() or body.startswith("#") or (line.lstrip(" \t").startswith("#")):
            pos = e + 1
        elif line.startswith("%"):
            pos = e + 1
        elif re.match(r"(?:---)(?:\s|$)", line):
            close(pos)
            put("---", pos)
            rest = line[3:].strip()
            if rest and not rest.startswith("#"):
                q = pos + line.index(rest, 3)
                pos = (node(q, -1, rest[0] not in "|>" and not re.match(r"[^\s#]+:(\s|$)", rest)) if rest[0] not in "|>" else block(q, -1)) + 1
            else:
                pos = e + 1
        elif re.match(r"\.\.\.(?:\s|$)", line):
            close(pos)
            put("---", pos)
            pos = e + 1
        else:
            if body.startswith("\t"):
                raise LexError(pos, "tab in indentation")
            col = len(line) - len(body)
            parent = max((s for s in stack if s < col), default=-1)
            pos = node(pos + col, parent, False) + 1
    close(n)
    return kinds, at, None


# ---------------------------------------------------------------- Python

_PYNUM = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)"
_PY = re.compile(
    rf"(?P<n>{_PYNUM})|(?P<q>(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:'''|\"\"\"|'|\"))|(?P<w>[^\W\d]\w*)"
    r"|(?P<o>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
_PYBAD_OCT = re.compile(r"0[0-9_]*[1-9]")


def _py_string(text: str, pos: int, quote: str, prefix: str) -> int:
    """The offset after the string whose opening quote ends at pos."""
    n, raw, f = len(text), "r" in prefix, "f" in prefix
    long = len(quote) == 3
    start = pos
    while pos < n:
        c = text[pos]
        if c == "\\":
            if not raw and "b" not in prefix and text[pos + 1 : pos + 2] == "N" and text[pos + 2 : pos + 3] != "{" :
                raise LexError(pos, "bad escape")
            if not raw and text[pos + 1 : pos + 2] == "x" and not re.compile(r"[0-9a-fA-F]{2}").match(text, pos + 2):
                raise LexError(pos, "bad escape")
            if not raw and "b" not in prefix and text[pos + 1 : pos + 2] in ("u", "U"):
                k = 4 if text[pos + 1] == "u" else 8
                if not re.compile(r"[0-9a-fA-F]{%d}" % k).match(text, pos + 2):
                    raise LexError(pos, "bad escape")
            pos += 2
        elif text.startswith(quote, pos):
            return pos + len(quote)
        elif c == "\n" and not long:
            break
        elif f and c == "{":
            if text.startswith("{{", pos):
                pos += 2
            else:
                pos = _py_field(text, pos + 1, quote)
        elif f and c == "}":
            if not text.startswith("}}", pos):
                raise LexError(pos, "single brace in a formatted string")
            pos += 2
        else:
            if "b" in prefix and ord(c) > 127:
                raise LexError(pos, "non-ASCII bytes")
            pos += 1
    raise LexError(start, "unclosed string")


def _py_field(text: str, pos: int, quote: str) -> int:
    """The offset after a replacement field of a formatted string."""
    depth, n, start, spec = 0, len(text), pos, False
    while pos < n:
        c = text[pos]
        if c == "}" and not depth:
            if not text[start:pos].strip():
                raise LexError(pos, "empty field")
            return pos + 1
        if spec:
            if c == "{":
                pos = _py_field(text, pos + 1, quote)
                continue
            if text.startswith(quote, pos) or c == "\n" and len(quote) == 1:
                break
            pos += 1
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and not depth and not text.startswith(":=", pos):
            spec = True
        elif c in "\"'":
            m = re.compile(r"'''|\"\"\"|'|\"").match(text, pos)
            word = re.search(r"([A-Za-z]{1,2})$", text[max(0, pos - 2) : pos])
            prefix = word.group(1).lower() if word and set(word.group(1).lower()) <= set("rbfu") else ""
            pos = _py_string(text, m.end(), m.group(), prefix)
            continue
        elif c == "\n" and len(quote) == 1 and not depth:
            pass
        pos += 1
    raise LexError(start, "unclosed field")


def lex_python(text: str):
    text = text.removeprefix("\ufeff") if text.startswith("\ufeff") else text
    if "\x00" in text:
        raise LexError(text.index("\x00"), "control character")
    kinds, at, nest, indents, pos, n = [], [], [], [(0, 0)], 0, len(text)

    def put(kind, p):
        kinds.append(kind)
        at.append(p)

    fresh = True
    while pos < n:
        if fresh and not nest:
            m = re.compile(r"[ \t\x0c]*").match(text, pos)
            q = m.end()
            if q < n and text[q] in "#\r\n" or q == n:
                e = text.find("\n", q)
                cr = text.find("\r", q)
                if cr >= 0 and (e < 0 or cr < e) and text[cr + 1 : cr + 2] != "\n":
                    e = cr
                pos = n if e < 0 else e + 1
                continue
            if text[q] != "\\":
                ws = m.group().rpartition("\x0c")[2]
                col = alt = 0
                for c in ws:
                    col = (col // 8 + 1) * 8 if c == "\t" else col + 1
                    alt += 1
                if col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        raise LexError(q, "inconsistent tabs")
                    indents.append((col, alt))
                    put("INDENT", q)
                else:
                    while col < indents[-1][0]:
                        indents.pop()
                        put("DEDENT", q)
                    if col != indents[-1][0]:
                        raise LexError(q, "bad dedent")
                    if alt != indents[-1][1]:
                        raise LexError(q, "inconsistent tabs")
            pos, fresh = q, False
            continue
        c = text[pos]
        if c in " \t\x0c":
            pos += 1
        elif c in "\r\n":
            pos += 2 if text.startswith("\r\n", pos) else 1
            if not nest:
                put("NEWLINE", pos - 1)
                fresh = True
        elif c == "#":
            m = re.compile(r"[^\r\n]*").match(text, pos)
            pos = m.end()
        elif c == "\\":
            m = re.compile(r"\\(?:\r\n|\n|\r)").match(text, pos)
            if not m or m.end() == n:
                raise LexError(pos, "stray backslash")
            pos = m.end()
        else:
            m = _PY.match(text, pos)
            if not m:
                raise LexError(pos, "stray character")
            g, s = m.lastgroup, m.group()
            if g == "w":
                if not s.isascii() and not unicodedata.normalize("NFKC", s).isidentifier():
                    raise LexError(pos, "stray character")
                put(s if s in PY_KEYWORDS or s in PY_SOFT else "NAME", pos)
            elif g == "n":
                tail = re.compile(r"\w+").match(text, m.end())
                if tail and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", tail.group()):
                    raise LexError(m.end(), "bad number")
                if _PYBAD_OCT.fullmatch(s):
                    raise LexError(pos, "bad number")
                put("NUMBER", pos)
            elif g == "q":
                quote = s[-3:] if s[-3:] in ("'''", '"""') else s[-1]
                prefix = s[: -len(quote)].lower()
                end = _py_string(text, m.end(), quote, prefix)
                put("BYTES" if "b" in prefix else "STRING", pos)
                pos = end
                continue
            else:
                put(s, pos)
                if s in "([{":
                    nest.append(s)
                elif s in ")]}":
                    if not nest or nest.pop() + s not in ("()", "[]", "{}"):
                        raise LexError(pos, "unmatched bracket")
            pos = m.end()
    if nest:
        raise LexError(n, "unclosed bracket")
    if kinds and kinds[-1] not in ("NEWLINE",) and not fresh:
        put("NEWLINE", n)
    for _ in indents[1:]:
        put("DEDENT", n)
    return kinds, at, None


# ---------------------------------------------------------------- JavaScript, TypeScript

_JS = re.compile(
    r"(?P<n>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)n?)"
    r"|(?P<w>[#@]?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)"
    r"|(?P<s>\"(?:[^\"\\\n\r]|\\(?:\r\n|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|[^ux]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|[^ux]))*')"
    r"|(?P<o>\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|<<=|<<|<=|>=|&=|\|=|\^=|[-+*/%&|^~!<>()\[\]{},;:.?=@])"
)
_JSRE = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JSTPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_VALUE_ENDS = frozenset("NAME NUMBER STRING TPL TPL_TAIL REGEX ) ] } this super null true false PRIVATE".split()) | JS_SOFT - {"await", "yield", "of"}


def lex_js(text: str):
    kinds, at, lines, pos, n, nest, new = [], [], [], 0, len(text), [], True

    def put(kind, p):
        nonlocal new
        kinds.append(kind)
        at.append(p)
        lines.append(new)
        new = False

    if text.startswith("\ufeff"):
        pos = 1
    if text.startswith("#!"):
        pos = text.find("\n")
        pos = n if pos < 0 else pos
    while pos < n:
        c = text[pos]
        if c in "\n\r\u2028\u2029":
            new = True
            pos += 1
        elif c in " \t\x0b\x0c\xa0\ufeff" or unicodedata.category(c) == "Zs":
            pos += 1
        elif text.startswith("//", pos):
            pos = re.compile(r"[^\n\r\u2028\u2029]*").match(text, pos).end()
        elif text.startswith("/*", pos):
            e = text.find("*/", pos + 2)
            if e < 0:
                raise LexError(pos, "unclosed comment")
            new = new or "\n" in text[pos:e]
            pos = e + 2
        elif c == "`" or (c == "}" and nest and nest[-1] == "${"):
            tail = c == "}"
            if tail:
                nest.pop()
            m = _JSTPL.match(text, pos + 1)
            if text.startswith("${", m.end()):
                put("TPL_MID" if tail else "TPL_HEAD", pos)
                nest.append("${")
                pos = m.end() + 2
            elif text.startswith("`", m.end()):
                put("TPL_TAIL" if tail else "TPL", pos)
                pos = m.end() + 1
            else:
                raise LexError(pos, "unclosed string")
        elif c == "/" and (not kinds or kinds[-1] not in _JS_VALUE_ENDS):
            m = _JSRE.match(text, pos)
            if not m:
                raise LexError(pos, "bad pattern")
            put("REGEX", pos)
            pos = m.end()
        else:
            m = _JS.match(text, pos)
            if not m:
                raise LexError(pos, "unclosed string" if c in "\"'" else "stray character")
            g, s = m.lastgroup, m.group()
            if g == "w":
                if s[0] == "@":
                    put("@", pos)
                    pos += 1
                    continue
                if not s.isascii() and not _ident_ok(s.lstrip("#").replace("$", "a").replace("\u200c", "").replace("\u200d", "")):
                    raise LexError(pos, "stray character")
                put("PRIVATE" if s[0] == "#" else s if s in JS_RESERVED or s in JS_SOFT else "NAME", pos)
            elif g == "n":
                if re.compile(r"[\w$]").match(text, m.end()) or re.match(r"0\d", text[pos : pos + 2]):
                    raise LexError(pos, "bad number")
                put("NUMBER", pos)
            elif g == "s":
                put("STRING", pos)
            else:
                put(s, pos)
                if s in "([{":
                    nest.append(s)
                elif s in ")]}":
                    if not nest or nest.pop() + s not in ("()", "[]", "{}"):
                        raise LexError(pos, "unmatched bracket")
            pos = m.end()
    if nest:
        raise LexError(n, "unclosed bracket")
    return kinds, at, lines


# ---------------------------------------------------------------- Go

_GO = re.compile(
    r"(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<w>[^\W\d]\w*)"
    r"|(?P<s>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|`[^`]*`)"
    r"|(?P<c>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<o>\.\.\.|&\^=|<<=|>>=|&\^|<<|>>|<-|\+\+|--|&&|\|\||:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^<>=!~()\[\]{},;:.])"
)
_GO_ENDS = frozenset("NAME NUMBER STRING CHAR break continue fallthrough return ++ -- ) ] }".split())


def lex_go(text: str):
    text = text.removeprefix("\ufeff")
    if "\x00" in text:
        raise LexError(text.index("\x00"), "control character")
    kinds, at, pos, n, nest = [], [], 0, len(text), []

    def put(kind, p):
        kinds.append(kind)
        at.append(p)

    def line(p):
        if kinds and kinds[-1] in _GO_ENDS:
            put(";", p)

    while pos < n:
        c = text[pos]
        if c == "\n":
            line(pos)
            pos += 1
        elif c in " \t\r":
            pos += 1
        elif text.startswith("//", pos):
            e = text.find("\n", pos)
            pos = n if e < 0 else e
        elif text.startswith("/*", pos):
            e = text.find("*/", pos + 2)
            if e < 0:
                raise LexError(pos, "unclosed comment")
            if "\n" in text[pos:e]:
                line(pos)
            pos = e + 2
        else:
            m = _GO.match(text, pos)
            if not m:
                raise LexError(pos, "unclosed string" if c in "\"`'" else "stray character")
            g, s = m.lastgroup, m.group()
            if g == "w":
                put(s if s in GO_KEYWORDS else "NAME", pos)
            elif g == "n":
                if re.compile(r"\w").match(text, m.end()):
                    raise LexError(pos, "bad number")
                put("NUMBER", pos)
            elif g in "sc":
                put("STRING" if g == "s" else "CHAR", pos)
            else:
                put(s, pos)
                if s in "([{":
                    nest.append(s)
                elif s in ")]}":
                    if not nest or nest.pop() + s not in ("()", "[]", "{}"):
                        raise LexError(pos, "unmatched bracket")
            pos = m.end()
    line(n)
    if nest:
        raise LexError(n, "unclosed bracket")
    return kinds, at, None


# ---------------------------------------------------------------- Java

_JAVA = re.compile(
    r"(?P<n>(?:0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F]*(?:[pP][+-]?\d+))|0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*|0[bB][01](?:_*[01])*|(?:\d(?:_*\d)*)?\.\d(?:_*\d)*(?:[eE][+-]?\d+)?|\d(?:_*\d)*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?)"
    r"|(?P<w>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<t>\"\"\"[ \t\x0c]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\")"
    r"|(?P<s>\"(?:[^\"\\\n\r]|\\(?:[btnfrs0-7\\\"']|u+[0-9a-fA-F]{4}))*\"(?!\"))"
    r"|(?P<c>'(?:[^'\\\n\r]|\\(?:[btnfrs\\\"']|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    r"|(?P<o>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%&|^~!<>()\[\]{},;:.?=@])"
)


def lex_java(text: str):
    text = text.removeprefix("\ufeff")
    kinds, at, pos, n, nest = [], [], 0, len(text), []
    while pos < n:
        c = text[pos]
        if c in " \t\r\n\x0c" or (c == "\x1a" and pos == n - 1):
            pos += 1
        elif text.startswith("//", pos):
            pos = re.compile(r"[^\n\r]*").match(text, pos).end()
        elif text.startswith("/*", pos):
            e = text.find("*/", pos + 2)
            if e < 0:
                raise LexError(pos, "unclosed comment")
            pos = e + 2
        else:
            m = _JAVA.match(text, pos)
            if not m:
                raise LexError(pos, "unclosed string" if c in "\"'" else "stray character")
            g, s = m.lastgroup, m.group()
            kind = s
            if g == "w":
                kind = s if s in JAVA_KEYWORDS or s in JAVA_SOFT else "NAME"
            elif g == "n":
                if re.compile(r"[\w$]").match(text, m.end()):
                    raise LexError(pos, "bad number")
                kind = "NUMBER"
            elif g in "tsc":
                kind = "STRING" if g != "c" else "CHAR"
            elif s in "([{":
                nest.append(s)
            elif s in ")]}":
                if not nest or nest.pop() + s not in ("()", "[]", "{}"):
                    raise LexError(pos, "unmatched bracket")
            kinds.append(kind)
            at.append(pos)
            pos = m.end()
    if nest:
        raise LexError(n, "unclosed bracket")
    return kinds, at, None


LEXERS = {
    "python": lex_python, "javascript": lex_js, "typescript": lex_js, "go": lex_go, "java": lex_java,
    "json": lex_json, "yaml": lex_yaml, "toml": lex_toml, "xml": lex_xml,
}


def lex(language: str, text: str):
    return LEXERS[language](text)
