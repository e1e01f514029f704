"""URL filters: rules by host and path, and a naive Bayes verdict on segmented names for the rest.

Names in hosts and paths are often words run together. A unigram model splits each by Viterbi into known words and
unknown rests, and a multinomial naive Bayes model scores the known words. Classes are learned from a small labelled table
(:data:`LABELLED`). The words are those of the table and the names that stand by themselves on several hosts of the
corpus, the most frequent ``VOCABULARY`` of them; how frequent a word is comes in equal parts from the table and from all
urls. A name that is a word is not split. Short words count only where they are unlikely to be there by chance
(:meth:`Judge.of_name`), and one word of :data:`CLEAR` is enough to block.

Defined cases: a null url and one without "://" have the host "" and the path ""; no rule fits an empty host, and a name
without a known word is allowed; equal urls get equal verdicts; a very long url is split name by name, each in time
proportional to its length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The labelled table from which the words and the classes are learned.
LABELLED = {
    "block": """
        casino-win/bonus casino-royal/slots online-casino/win poker-room/jackpot free-bets/odds sports-betting/bets best-bet/bonus
        cheap-pills/buy buy-viagra/cheap discount-pharmacy/pills weight-loss-pills/buy adult-x/video adult-video/xxx xxx-porn/tube
        sex-chat/adult porn-x/free hot-escort/dating adult-dating/sex spam-farm/links link-farm/spam spam-mail/bulk ads-track/click
        ad-track/pixel track-click/ads banner-ads/popup popup-ads/track free-crack/download warez-keygen/crack torrent-warez/free
        payday-loan/cash fast-cash/loan replica-watches/cheap malware-download/virus phishing-bank/verify lottery-win/prize
        free-prize/winner easy-money/fast miracle-diet/pills slots-jackpot/spin
    """,
    "allow": """
        daily-news/article city-news/local public-library/books university/research science-journal/article open-source/docs
        school-history/lesson art-museum/exhibition travel-guide/europe garden-recipes/soup football-club/results music-review/album
        code-blog/post book-club/review government/services family-kitchen/recipes photo-gallery/nature film-festival/program
        health-clinic/advice weather-report/forecast language-school/course community-forum/thread wiki-encyclopedia/history
        kids-learning/games farm-market/fruit bank/about mobile-blog/page  train-track/timetable
        free-software/download home-page/welcome local-shop/contact press-release/story research-institute/paper
        math-course/lecture street-map/city race-track/results order-track/status free-time/hobby
    """,
}
#: Words of the table that block by themselves, and beside one allowed word too.
CLEAR = frozenset("casino slots poker jackpot viagra porn xxx escort phishing malware keygen warez".split())
#: Bounds of what the corpus adds to the vocabulary: words, and UTF-8 bytes of a word.
VOCABULARY, LONGEST = 100_000, 24
#: A corpus name that contains a word of the table of this many letters is split and no word itself.
TELLING = 6
#: With words of the corpus known, each letter of an unknown name is as likely as this.
LETTER = 1 / 3
#: Probability that an unknown name has one letter more, and share of the labelled table in a word's frequency.
UNKNOWN = 0.4
TABLE_SHARE = 0.5
#: Log-odds from which a url is blocked.
BLOCKED_FROM = 1.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = re.compile(r"[^\W\d_]+")


def host_of(url: Column) -> Column:
    """What stands after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; "" if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def names(text: str) -> list[str]:
    return NAME.findall(text.lower())


def labelled() -> list[tuple[str, list[str]]]:
    return [(label, names(url)) for label, urls in LABELLED.items() for url in urls.split()]


class Words:
    """The unigram model: log-probability of every known word; unknown ones by length."""

    def __init__(self, seen: dict[str, int]):
        table = Counter(w for _, words in labelled() for w in words)
        self.table = frozenset(table)
        every, found = sum(table.values()), sum(seen.values())
        share = 1.0 if not found else TABLE_SHARE
        self.log = {w: math.log(share * n / every + (1 - share) * seen.get(w, 0) / max(1, found)) for w in [*table, *(seen.keys() - table.keys())] if (n := table[w]) or seen[w]}
        self.rare = math.log(share / every)
        self.longest = max(map(len, self.log))
        self.step = math.log(UNKNOWN if self.log.keys() == table.keys() else UNKNOWN * LETTER)

    def split(self, name: str) -> list[str]:
        """The most probable split; a run of unknown letters is one word and gives none."""
        # best[i][k]: score up to i, where k says whether an unknown word ends there (1) or a known one (0)
        best = [(0.0, float("-inf"))]
        back: list[tuple[tuple[int, int], tuple[int, int]]] = [((0, 0), (0, 0))]
        step = self.step
        for end in range(1, len(name) + 1):
            known, of_known = float("-inf"), (0, 0)
            for start in range(max(0, end - self.longest), end):
                p = self.log.get(name[start:end])
                if p is not None:
                    k = int(best[start][1] > best[start][0])
                    if best[start][k] + p > known:
                        known, of_known = best[start][k] + p, (start, k)
            begin, go_on = best[end - 1][0] + self.rare + step, best[end - 1][1] + step
            best.append((known, max(begin, go_on)))
            back.append((of_known, (end - 1, int(go_on > begin))))
        out, at, k = [], len(name), int(best[-1][1] > best[-1][0])
        while at:
            start, before = back[at][k]
            if not k:
                out.append(name[start:at])
            at, k = start, before
        return out[::-1]


class Judge:
    """Multinomial naive Bayes over split names, with one count added to each word of a class."""

    def __init__(self, seen: dict[str, int]):
        self.words = Words(seen)
        rows = labelled()
        counts = {label: Counter(w for own, words in rows if own == label for w in words) for label in LABELLED}
        sums = {label: sum(c.values()) + len(self.words.table) for label, c in counts.items()}
        self.odds = {w: math.log((counts["block"][w] + 1) / sums["block"]) - math.log((counts["allow"][w] + 1) / sums["allow"]) for w in self.words.table}
        share = {label: sum(own == label for own, _ in rows) for label in LABELLED}
        self.prior = math.log(share["block"] / share["allow"])
        enough = BLOCKED_FROM + abs(self.prior) - min(self.odds.values())  # beside one allowed word too
        self.odds |= {w: max(self.odds[w], enough) for w in CLEAR}
        self.known: dict[str, float] = {}

    def of_name(self, name: str) -> float:
        """Log-odds of a name. With words of the corpus known, a word of the table counts inside a longer name if it has
        five letters, or four and no letter is unknown, or if all other words are of the table too."""
        if name not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[name] = self._odds_of(name)
        return self.known[name]

    def _odds_of(self, name: str) -> float:
        words = self.words
        parts = [name] if name in words.log else words.split(name)
        known = sum(map(len, parts)) == len(name)
        least = 1 if len(words.log) == len(words.table) or known and words.table.issuperset(parts) else 4 if known else 5
        return sum(self.odds.get(w, 0.0) for w in parts if len(w) >= least)

    def score(self, host: str, path: str) -> float:
        return self.prior + sum(map(self.of_name, names(host))) + sum(map(self.of_name, names(path)))


def occurrences(urls: DataFrame) -> dict[str, int]:
    """How often each word stands by itself in a host or path: those of the table, and up to ``VOCABULARY`` of the corpus.

    A word of the corpus stands on two hosts at least, not counting www and m before a host; a host's last label is none.
    """
    table = sorted({w for _, words in labelled() for w in words})
    site = F.regexp_replace("host", r"^(?:www|m)\.", "")
    text = F.concat_ws("/", F.regexp_replace("host", r"\.[^.]*$", ""), "path")
    found = urls.select(site.alias("site"), F.explode(F.split(text, r"[^\p{L}]+")).alias("name")).select("site", F.translate("name", UPPER, LOWER).alias("name"))
    found = found.where(F.col("name").isin(table) | (F.length("name") > 1) & (F.octet_length("name") <= LONGEST))
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("least"), F.max("site").alias("most"))
    listed = F.col("name").isin(table)
    telling = F.col("name").rlike("|".join(w for w in table if len(w) >= TELLING))
    known = counts.where(listed | (F.col("least") != F.col("most")) & ~telling)
    rows = known.select("name", "n").orderBy(F.desc(listed), F.desc("n"), "name").limit(len(table) + VOCABULARY).collect()
    return {r["name"]: r["n"] for r in rows}


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; a rule fits its host and all below it, and paths that start so."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(says)
    return rule, says


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """For every row ``key``, host, path, rule, verdict and the model's score (log-odds of block)."""
    kind = pages.schema[key].dataType.simpleString()
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = occurrences(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(seen)
        for batch in batches:
            scores = [own.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["key", "host", "path", "score"])

    scored = parts.mapInArrow(run, f"key {kind}, host string, path string, score double")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= BLOCKED_FROM, "block").otherwise("allow")
    return scored.select("key", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "score")


def verdicts(pages: DataFrame) -> DataFrame:
    """The query's digest: page_id, host, path, rule, verdict and score."""
    return judge(pages).withColumnRenamed("key", "page_id")
