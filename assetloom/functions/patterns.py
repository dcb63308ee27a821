"""Every regular expression of the engine, spelled for Spark (Java) and for DuckDB (RE2).

Word characters, white space and line breaks are Unicode and written out, because the engines'
own classes differ.  No pattern repeats a group without bound: that overflows Java's stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

WORD = r"\p{L}\p{N}_"
JAVA_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RE2_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_RUN = "\"'`<>\\\\"  # what ends a URL, besides white space

URLS = f"(?:https?:)?//[^{JAVA_SPACE}{_RUN}]+"
WEBSOCKETS = f"(?iu)wss?://[^{JAVA_SPACE}{_RUN}]+"
ENDPOINTS = rf"(?iu)(?<![{WORD}/])/(?:api|graphql|v[0-9]+|rest)[A-Za-z0-9_./?=&$\{{\}}:\-]*"
IMPORTS = rf"(?:import[{JAVA_SPACE}]*(?:[^'\"()]*?[{JAVA_SPACE}]+from[{JAVA_SPACE}]*)?|require[{JAVA_SPACE}]*\()[\"']([^\"']+)[\"']"

RE2_URLS = f"(?:https?:)?//[^{RE2_SPACE}{_RUN}]+"
RE2_WEBSOCKETS = f"(?i)wss?://[^{RE2_SPACE}{_RUN}]+"
RE2_ENDPOINTS = rf"(?i)(?:^|[^{WORD}/])(/(?:api|graphql|v[0-9]+|rest)[A-Za-z0-9_./?=&$\{{\}}:\-]*)"
RE2_IMPORTS = rf"(?:import[{RE2_SPACE}]*(?:[^'\"()]*?[{RE2_SPACE}]+from[{RE2_SPACE}]*)?|require[{RE2_SPACE}]*\()[\"']([^\"']+)[\"']"

#: The tokens by which a technology is recognised, in reporting order.
TECHNOLOGIES = {
    "React": ["React", "ReactDOM", "createElement", "useState"],
    "Vue": ["Vue", "createApp", "defineComponent"],
    "Angular": ["@angular", "ngOnInit", "NgModule"],
    "Next.js": ["__NEXT_DATA__", "next/router", "next/dist"],
    "Nuxt": ["__NUXT__", "nuxt", "nuxt.js"],
    "Svelte": ["SvelteComponent", "svelte/internal"],
    "Webpack": ["webpackJsonp", "__webpack_require__"],
    "Vite": ["import.meta.hot", "/@vite/client"],
    "Rollup": ["rollupPlugin", "__commonJS"],
}

#: URLs kept by the crawl filter, in any case.
CANDIDATE = r"(?i)\.(js|mjs|map|json|wasm)([?#].*)?$|(^|[/._-])(service-)?worker([._/?#-]|$)|manifest(\.json|\.webmanifest)?([?#].*)?$"
#: Fixed value: what makes a path a worker's.
WORKER = r"(^|[._/-])(service-)?worker([._/-]|$)"


def _literal(token: str) -> str:
    return re.sub(r"([.@/*+?()\[\]{}|^$\\])", r"\\\1", token)


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def technology(tokens: Iterable[str]) -> str:
    """Java: any token between word boundaries. Next to a token's own first or last character a boundary is one look at the neighbour."""
    ways = []
    for first in (True, False):
        for last in (True, False):
            own = [_literal(t) for t in tokens if (_wordy(t[0]), _wordy(t[-1])) == (first, last)]
            if own:
                ways.append(f"(?<{'!' if first else '='}[{WORD}])(?:{'|'.join(own)})(?{'!' if last else '='}[{WORD}])")
    return "(?iu)" + "|".join(ways)


def re2_technology(tokens: Iterable[str]) -> str:
    """RE2 has no look-around: the neighbours are consumed, one alternative a token."""
    ways = []
    for t in tokens:
        before = f"(?:^|[^{WORD}])" if _wordy(t[0]) else f"[{WORD}]"
        after = f"(?:[^{WORD}]|$)" if _wordy(t[-1]) else f"[{WORD}]"
        ways.append(before + _literal(t) + after)
    return "(?i)" + "|".join(ways)
