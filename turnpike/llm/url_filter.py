"""URL filtering: host and path rules first, else a weighted vocabulary matched by Aho-Corasick.

A vocabulary term counts where it stands between boundaries (anything but letters and digits, or an end).
One strict term rejects a URL, and so do several distinct soft terms whose weights add up to the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default vocabulary. A strict term has no harmless reading and rejects alone.
STRICT = (
    "bestiality", "blowjob", "camgirl", "camgirls", "cumshot", "gangbang", "hentai", "milf", "porn", "porno", "pornos",
    "pornstar", "pornstars", "sexcam", "sexcams", "warez", "xvideos", "xxx",
)
# Soft terms and their evidence; words with harmless readings weigh less, general lures least.
SOFT = {
    # adult
    "adult": 8, "amateur": 6, "anal": 12, "bdsm": 14, "escort": 12, "escorts": 14, "erotic": 12, "erotica": 12, "erotik": 12, "fetish": 12,
    "nude": 10, "nudes": 13, "sex": 10, "sexe": 10, "sexo": 10, "sexy": 11, "strip": 6, "webcam": 7,
    # gambling
    "apuestas": 13, "bet": 12, "bets": 13, "betting": 13, "blackjack": 13, "bookmaker": 13, "casino": 14, "casinos": 14, "gambling": 12, "jackpot": 12,
    "kasino": 14, "kasyno": 14, "lotto": 9, "poker": 12, "roulette": 12, "scommesse": 13, "slot": 7, "slots": 11, "wetten": 10,
    # medicines and diets
    "cialis": 15, "diet": 6, "levitra": 15, "pharma": 8, "pharmacy": 8, "pill": 11, "pills": 12, "slimming": 11, "steroids": 11, "tramadol": 14,
    "viagra": 15, "xanax": 14,
    # copies and piracy
    "crack": 11, "cracked": 12, "keygen": 15, "nulled": 14, "pirated": 10, "replica": 11, "replicas": 12, "serials": 8, "torrent": 9, "torrents": 10,
    # money and spam
    "backlinks": 12, "casinobonus": 15, "credit": 4, "dating": 10, "doorway": 8, "farm": 8, "forex": 11, "kredit": 5, "loan": 8, "loans": 9,
    "payday": 12, "spam": 12, "spammer": 12, "traffic": 4,
    # lures
    "bonus": 8, "buy": 4, "cheap": 8, "deal": 4, "deals": 5, "discount": 5, "free": 7, "gratis": 7, "kostenlos": 6, "online": 3,
    "win": 7, "winner": 6,
}
#: Soft terms reject together from this sum of weights on, and only if there are so many distinct ones.
SOFT_LIMIT, SOFT_LEAST = 20, 2

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


class Matcher:
    """Rules by host, and the automaton of the vocabulary."""

    def __init__(self, rules: Sequence[Rule], strict: Sequence[str], soft: dict[str, float], soft_limit: float, soft_least: int = SOFT_LEAST):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule[1], []).append(rule)
        self.soft_limit, self.soft_least = soft_limit, soft_least
        self.terms = ahocorasick.Automaton()
        for term in soft:
            self.terms.add_word(term, (term, len(term), soft[term], False))
        for term in strict:
            self.terms.add_word(term, (term, len(term), 0, True))
        self.has_terms = len(self.terms) > 0
        if self.has_terms:
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule, host and path together, of the host or a domain above it whose path starts the URL's."""
        best, name = None, host
        while name:
            for rule in self.by_host.get(name, ()):
                if path.startswith(rule[2]) and (best is None or len(rule[1]) + len(rule[2]) > len(best[1]) + len(best[2])):
                    best = rule
            _, dot, name = name.partition(".")
            if not dot:
                break
        return best

    def hits(self, url: str) -> tuple[int, int, float]:
        """Distinct strict terms, distinct soft terms and the sum of their weights, found between boundaries."""
        text = url.translate(_LOWER)
        strict, soft = set(), {}
        if self.has_terms:
            for end, (term, length, weight, is_strict) in self.terms.iter(text):
                start = end - length
                if (start < 0 or not _is_alnum(text[start])) and (end + 1 == len(text) or not _is_alnum(text[end + 1])):
                    if is_strict:
                        strict.add(term)
                    else:
                        soft[term] = weight
        return len(strict), len(soft), float(sum(soft.values()))

    def rejects(self, n_strict: int, n_soft: int, weight: float) -> bool:
        return n_strict > 0 or (n_soft >= self.soft_least and weight >= self.soft_limit)


def _is_alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = (),
    *,
    strict: Sequence[str] = STRICT,
    soft: dict[str, float] | None = None,
    soft_limit: float = SOFT_LIMIT,
    soft_least: int = SOFT_LEAST,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id_col, host, path, rule, verdict, n_strict, n_soft, soft_weight`` for every row; a map without shuffle.

    ``rule`` is host and path prefix of the rule that decides, null if none fits. Null and empty URLs and those
    without ``://`` have empty host and path; no rule fits them and the vocabulary judges what text there is, so
    null is allowed. Repeated rows give repeated rows; other columns are not read.
    """
    soft = SOFT if soft is None else soft
    id_type = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules, strict, soft, soft_limit, soft_least)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = matcher.rule(host, path)
                found = matcher.hits(url or "")
                verdict = rule[0] if rule else "block" if matcher.rejects(*found) else "allow"
                rows.append((host, path, rule and rule[1] + rule[2], verdict, *found))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                [id_col, "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"],
            )

    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(run, schema)
