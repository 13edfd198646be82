"""Search plans: what a query text asks the index for.

Planning happens once per query on the driver; the plan's terms are then literals
of the DataFrame plan.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

MAX_TERMS = 20

# Words that a query is too wide to look for.
STOP_WORDS = frozenset(
    ["的", "了", "是", "在", "和", "与", "及", "或", "对", "为", "以", "把", "被", "从", "到"]
    + "the a an and or to of is are for in on with this that it as be by from".split()
)
_CJK = re.compile("[㐀-䶿一-鿿豈-﫿]")
_RUN = re.compile("[㐀-䶿一-鿿豈-﫿]{2,}")
_QUOTES = "\"“”'‘’"


def normalize(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").replace("\0", "")


def tokenize(text: str) -> list[str]:
    """Distinct words of 1 to 64 characters, the first form kept."""
    seen: dict[str, str] = {}
    for word in re.findall(r"[^\W_]+", normalize(text)):
        if len(word) <= 64:
            seen.setdefault(word.lower(), word)
    return list(seen.values())


def bigrams(text: str) -> list[str]:
    return list(dict.fromkeys(run[i : i + 2] for run in _RUN.findall(normalize(text)) for i in range(len(run) - 1)))


def phrases_of(text: str) -> list[str]:
    """What stands in straight or curly quotes, 2 to 60 characters."""
    found = (m.strip() for m in re.findall(f"[{_QUOTES}]([^{_QUOTES}]{{2,60}})[{_QUOTES}]", normalize(text)))
    return [p for p in found if p]


def query_terms(text: str) -> list[str]:
    """Words that aren't stop words, then bigrams.  Single ideographs count only when no longer word is there."""
    words = [w for w in tokenize(text) if w.lower() not in STOP_WORDS]
    pairs = bigrams(text)
    if any(len(w) >= 2 for w in [*words, *pairs]):
        words = [w for w in words if len(w) > 1 or not _CJK.match(w)]
    folded = {w.lower() for w in words}
    return (words + [b for b in pairs if b not in folded])[:MAX_TERMS]


@dataclass(frozen=True)
class SearchPlan:
    """phrases and terms as typed; word_terms: what the word index is asked for; substring: terms of three characters or
    more; single: terms of one."""

    phrases: tuple[str, ...]
    terms: tuple[str, ...]

    @property
    def word_terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.lower() for t in self.terms))

    @property
    def substring(self) -> tuple[str, ...]:
        return tuple(t for t in self.terms if len(t) >= 3)

    @property
    def single(self) -> tuple[str, ...]:
        return tuple(t for t in self.terms if len(t) == 1)

    @property
    def contained(self) -> tuple[str, ...]:
        """Terms looked up as substrings, in the order that fixes their rank."""
        return self.substring + self.single

    def __bool__(self) -> bool:
        return bool(self.terms or self.phrases)


def build_plan(text: str) -> SearchPlan:
    phrases, terms = phrases_of(text), query_terms(text)
    for phrase in phrases:
        terms += [w for w in tokenize(phrase) if w not in terms]
    return SearchPlan(tuple(phrases), tuple(terms[:MAX_TERMS]))


def ext_list(value) -> list[str]:
    """Extensions from a list or a text separated by commas or spaces: lower case, with their dot."""
    parts = re.split(r"[,\s]+", value) if isinstance(value, str) else list(value or [])
    return ["." + p.strip().lower().lstrip(".") for p in parts if p and p.strip().strip(".")]
