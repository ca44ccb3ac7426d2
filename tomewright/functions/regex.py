"""Translation of ECMAScript regular expressions to the JVM's dialect.

The two dialects disagree on what ``\\s``, ``\\b``, ``.``, ``^`` and ``$`` mean. Every pattern of
this package is written once, in ECMAScript notation, and spelled out here so that the JVM gives
the same matches.
"""

from __future__ import annotations

from functools import lru_cache

# White space and line ends as ECMAScript defines them; valid inside a bracket class.
WS = (r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
      r"\x{3000}\x{FEFF}")
EOL = r"\n\r\x{2028}\x{2029}"
WORD = "[A-Za-z0-9_]"

_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_LINE_START = rf"(?:\A|(?<=[{EOL}]))"
_LINE_END = rf"(?:(?=[{EOL}])|\z)"


@lru_cache(maxsize=None)
def jvm(pattern: str, flags: str = "") -> str:
    """Spell an ECMAScript pattern so that ``java.util.regex`` matches the same text."""
    multiline = "m" in flags
    outside = {
        r"\s": f"[{WS}]",
        r"\b": _BOUNDARY,
        ".": f"[^{EOL}]",
        "^": _LINE_START if multiline else r"\A",
        "$": _LINE_END if multiline else r"\z",
    }
    inside = {r"\s": WS, "[": r"\[", "&": r"\&"}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        if in_class:
            in_class = token != "]"
            out.append(inside.get(token, token))
        elif token == "[":
            in_class = True
            # "[^" opens a negated class; the caret belongs to it.
            token = "[^" if pattern[i + 1:i + 2] == "^" else "["
            out.append(token)
        else:
            out.append(outside.get(token, token))
        i += len(token)
    return ("(?i)" if "i" in flags else "") + "".join(out)
