"""Phrase collocations from depth-truncated suffix trees, partitioned by word prefixes.

Every word occurrence starts a suffix of at most four words that ends with its piece. The
suffixes are partitioned vertically by a memory budget: words are counted first, and a
prefix that starts more suffixes than the budget is extended by a word, which takes one more
pass over the texts that counts only what begins with such a prefix. All prefixes that were
not extended are dealt into groups of about the budget. Each group's suffixes go to one
task, which puts them in order, builds the truncated subtrees of its prefixes and reads the
counts of phrases from leaf totals, independently of all other groups. Prefixes that were
extended have been counted while partitioning.

On the way to its group a suffix travels packed: a task numbers the words of its texts,
counts equal suffixes (the leaves) and sends each group one block of leaves with the words
used there, so hot phrases are added up before the shuffle.

Phrases of at least `least` occurrences are the nodes of that tree. Cuts of a phrase and
the phrases inside a longer one are nodes too, as a part occurs at least as often as the
whole, so scores and nesting are joins of the node table with itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import cut

ENDS = b".,;:!?\n\x0b\x0c\r"
DEPTH = 4
_PLAIN = bytes(range(256)).lower().translate(bytes(10 if c in ENDS else 32 if c == 9 else c for c in range(256)))
_FLUSH = 2_000_000  # words that are numbered and counted together
_LISTED = 100_000  # prefixes of a level that may be extended, and so broadcast


class Words:
    """The words of one language's texts as numbers; 0 ends a suffix, 1 a piece."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number = defaultdict(count().__next__)
        self.number[b""], self.number[b"\n"]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        tokens = text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.number.__getitem__, tokens), "int64", len(tokens))
        codes = codes[codes > 0]
        self.parts += [codes, np.ones(1, "int64")]
        self.size += len(codes)

    def suffixes(self) -> np.ndarray:
        """One column per word occurrence: the numbers of its suffix, zeros past the end."""
        codes = np.concatenate([*self.parts, np.ones(DEPTH, "int64")])
        at = np.flatnonzero(codes > 1)
        rows = np.zeros((DEPTH, len(at)), "int64")
        alive = np.ones(len(at), bool)
        for k in range(DEPTH):
            word = codes[at + k]
            alive &= word > 1
            rows[k] = np.where(alive, word, 0)
        return rows


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns in order, and for each depth whether a column begins a new prefix of that depth."""
    pair = lambda k: rows[k] << 32 | rows[k + 1]
    order = np.lexsort((pair(2), pair(0)))
    rows = rows[:, order]
    new = np.zeros((DEPTH, rows.shape[1]), bool)
    new[:, :1] = True
    for k in range(DEPTH):
        new[k, 1:] = (rows[k, 1:] != rows[k, :-1]) | (new[k - 1, 1:] if k else False)
    return order, new


def _leaves(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes in order, and how often each occurs."""
    rows = words.suffixes()
    order, new = _runs(rows)
    starts = np.flatnonzero(new[DEPTH - 1])
    return rows[:, order[starts]], np.diff(np.append(starts, len(order)))


def _by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Words]]:
    """Words of texts in turn, one language at a time, as soon as there are enough; what is left at the end."""
    held: dict[str, Words] = defaultdict(Words)
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words = held[lang]
            words.add(text)
            if words.size >= _FLUSH or len(words.number) >= _FLUSH // 4:
                yield lang, words
                words.clear()
        if sum(w.size for w in held.values()) >= 2 * _FLUSH:  # many languages, little of each
            yield from held.items()
            held.clear()
    yield from held.items()


class Partition:
    """Prefixes to be extended, by language and number of words, and the number of groups."""

    def __init__(self, heavy: Iterable[tuple[str, bytes]], groups: int):
        self.groups = groups
        self.heavy: dict[str, list[list[tuple[bytes, ...]]]] = defaultdict(lambda: [[] for _ in range(DEPTH)])
        for lang, prefix in heavy:
            words = tuple(prefix.split(b" "))
            self.heavy[lang][len(words)].append(words)

    def __reduce__(self):
        return Partition, ([(lang, b" ".join(p)) for lang, levels in self.heavy.items() for level in levels for p in level], self.groups)

    def begins(self, lang: str, depth: int, number: dict[bytes, int], rows: np.ndarray) -> np.ndarray:
        """Which columns begin with a listed prefix of `depth` words."""
        known = [[number.get(w, -1) for w in p] for p in self.heavy[lang][depth]] if lang in self.heavy else []
        known = np.array([p for p in known if min(p) > 1], "int64").reshape(-1, depth)
        out = np.zeros(rows.shape[1], bool)
        if len(known):
            top = max(number.values()) + 1
            some = np.flatnonzero(np.isin(rows[0], known[:, 0]))
            # prefixes as numbers: each depth numbers the pairs of the one before and its word
            a, b = rows[0, some], known[:, 0]
            for k in range(1, depth):
                ids, both = np.unique(np.concatenate([a * top + rows[k, some], b * top + known[:, k]]), return_inverse=True)
                a, b = both[: len(a)], both[len(a) :]
            out[some] = np.isin(a, b)
        return out

    def route(self, lang: str, number: dict[bytes, int], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, words of the prefix that decides it) of each column."""
        hashed = np.array([0, 0] + [xxhash.xxh64_intdigest(w) for w in list(number)[2:]], "uint64")
        mix = np.uint64(0x9E3779B97F4A7C15)
        key = hashed[rows[0]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1))
        depth = np.ones(rows.shape[1], "int64")
        more = np.ones(rows.shape[1], bool)
        for k in range(1, DEPTH):
            more &= self.begins(lang, k, number, rows)
            if not more.any():
                break
            key[more] = (key[more] * mix ^ key[more] >> np.uint64(29)) + hashed[rows[k, more]]
            depth[more] = k + 1
        key = (key ^ key >> np.uint64(31)) * mix
        return (key >> np.uint64(20)) % np.uint64(self.groups), depth


def _counts(part: Partition | None, depth: int):
    """Counts words of a prefix that is to be extended with `depth` words; all words at depth 1, and their sum without a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words in _by_lang(batches):
            names = list(words.number)
            if depth == 1:
                codes, c = np.unique(np.concatenate([np.zeros(0, "int64"), *words.parts]), return_counts=True)
                found, c = [names[i] for i in codes.tolist()], c.tolist()
                if found and found[0] == b"\n":
                    found, c = found[1:], c[1:]
                found, c = [*found, None], [*c, sum(c)]
            else:
                rows = words.suffixes()
                # only what begins with a listed prefix is put in order
                some = part.begins(lang, depth - 1, words.number, rows) & (rows[depth - 1] > 0)
                prefix = np.zeros((DEPTH, int(some.sum())), "int64")
                prefix[:depth] = rows[:depth, some]
                order, new = _runs(prefix)
                starts = np.flatnonzero(new[DEPTH - 1])
                found = [b" ".join(names[i] for i in k) for k in prefix[:depth, order[starts]].T.tolist()]
                c = np.diff(np.append(starts, len(order))).tolist()
            yield pd.DataFrame({"lang": np.full(len(found), lang, object), "prefix": np.array(found, object), "c": np.array(c, "int64")})

    return run


def _send(part: Partition):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(1).compress
        for lang, words in _by_lang(batches):
            leaf, c = _leaves(words)
            if not leaf.size:
                continue
            names = np.array(list(words.number), object)
            group, depth = part.route(lang, words.number, leaf)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else []
            for a, b in zip(starts, [*starts[1:], len(order)]):
                at = order[a:b]
                used, own = np.unique(leaf[:, at], return_inverse=True)
                data = np.concatenate([own.reshape(DEPTH, -1) + int(used[0] > 0), c[at][None], depth[at][None]]).astype("<u4")
                text = b" ".join(names[used[used > 0]])
                yield pd.DataFrame({"group": [int(group[at[0]])], "lang": [lang], "words": [pack(text)], "leaves": [pack(data.tobytes())]})

    return run


def _subtrees(least: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        lang, phrase, size, f = [], [], [], []
        for name, part in rows.groupby("lang"):
            number = defaultdict(count(1).__next__)
            blocks = []
            for words, leaves in zip(part["words"], part["leaves"]):
                own = np.array([0, *map(number.__getitem__, unpack(words).split(b" "))], "int64")
                data = np.frombuffer(unpack(leaves), "<u4").reshape(DEPTH + 2, -1).astype("int64")
                data[:DEPTH] = own[data[:DEPTH]]
                blocks.append(data)
            data = np.concatenate(blocks, axis=1)
            del blocks
            order, new = _runs(data[:DEPTH])
            names = [None, *number]
            totals, route = data[DEPTH][order], data[DEPTH + 1][order]
            for k in range(DEPTH):
                starts = np.flatnonzero(new[k])
                sums = np.add.reduceat(totals, starts)
                first = order[starts]
                node = (sums >= least) & (data[k, first] > 0) & (route[starts] <= k + 1)
                phrase += [b" ".join([names[i] for i in w]).decode("utf-8", "surrogatepass") for w in data[: k + 1, first[node]].T.tolist()]
                f += sums[node].tolist()
                size += [k + 1] * int(node.sum())
                lang += [name] * int(node.sum())
        return pd.DataFrame({"lang": np.array(lang, object), "phrase": np.array(phrase, object), "size": np.array(size, "int32"), "f": np.array(f, "int64")})

    return run


def nodes(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, budget: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f): all phrases of at most four words and at least `least` occurrences; (lang, n): all words.

    `budget`: suffixes of one group of subtrees, those that one task holds (as leaves that
    are added up, and by chance somewhat more, as prefixes are dealt by hash). It grows
    with the input beyond `_LISTED` times itself, so that the broadcast list of extended
    prefixes keeps its bound.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tally = lambda part, depth: texts.mapInPandas(_counts(part, depth), "lang string, prefix binary, c long").groupBy("lang", "prefix").agg(F.sum("c").alias("f"))
    first = cut(tally(None, 1).filter(F.col("prefix").isNull() | (F.col("f") > budget)))
    n = first.filter("prefix IS NULL AND f > 0").select("lang", F.col("f").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // _LISTED))
    level, heavy, listed = first.filter(F.col("prefix").isNotNull() & (F.col("f") > budget)), [], []
    for depth in range(1, DEPTH):
        found = level.collect()  # at most total / budget
        if not found:
            break
        heavy.append(level.withColumn("size", F.lit(depth)))
        listed += [(r["lang"], bytes(r["prefix"])) for r in found]
        if depth + 1 < DEPTH:
            level = cut(tally(Partition(listed, 1), depth + 1).filter(F.col("f") > budget))
    part = Partition(listed, max(1, -(-total // budget)))
    sent = texts.mapInPandas(_send(part), "group long, lang string, words binary, leaves binary")
    tree = sent.groupBy("group").applyInPandas(_subtrees(least), "lang string, phrase string, size int, f long")
    for level in heavy:
        tree = tree.unionByName(level.filter(F.col("f") >= least).select("lang", F.decode("prefix", "UTF-8").alias("phrase"), "size", "f"))
    return cut(tree), n


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int | None = 2000, inside: int = 80, budget: int = 2_000_000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of each language, best first.

    Texts are lower-cased in A-Z and split at `ENDS` into pieces, and those at
    spaces and tabs into words. a, l and r are the occurrences of a phrase of 2 to 4 words and of the
    two parts at its worst cut (the lowest score, then the shortest first part), n those of
    all words, score = floor(2000000 * a / (l + r)). Phrases below `least` occurrences go,
    and those inside a longer one that has `inside` percent of their occurrences or more.
    `top` per language is the feature (None: all). Order: score and a falling, phrase rising by UTF-8 bytes.

    NULL texts and those without words add nothing; a NULL language is `und`. A repeated
    row counts again. A text is split whole, whatever its length. An empty table, or one
    without phrases, gives an empty result. Other columns play no part.
    """
    tree, n = nodes(docs, text, lang, least, budget)
    return ranked(tree, n, top, inside)


def ranked(tree: DataFrame, n: DataFrame, top: int | None = 2000, inside: int = 80) -> DataFrame:
    """The collocations of a node table (lang, phrase, size, f) and its languages' words (lang, n), see collocations()."""
    words = F.split("phrase", " ")
    longer = tree.filter(F.col("size") >= 2).select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))

    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(1, k).alias("first"), part(k + 1, F.col("size") - k).alias("rest")))
    at = longer.select("lang", "phrase", "a", F.inline(cuts))
    counts = tree.select("lang", "phrase", "f")
    at = at.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    at = at.withColumn("a2", wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("lr", wide("l") + wide("r"))
    at = at.withColumn("score", F.expr("a2 div lr"))
    worst = at.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    parts = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: part(i, k))))
    covers = longer.filter(F.col("size") >= 3).select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    covered = F.coalesce(wide("longest") * 100 >= wide("a") * inside, F.lit(False))
    kept = worst.join(covers, ["lang", "phrase"], "left").filter(~covered)
    out = kept.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same over `documents` in SQL.
COLLOCATION_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), listed AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM piece
), gram AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed) AS s, (VALUES (1), (2), (3), (4)) AS v(k)
  WHERE i + k - 1 <= len(ws)
), total AS (
  SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang
), f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k >= 2) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), cover AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM f WHERE k >= 3) AS c, (VALUES (2), (3)) AS v(m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, l, r, n, score
FROM worst AS w JOIN total USING (lang) LEFT JOIN cover AS c ON c.lang = w.lang AND c.phrase = w.phrase
WHERE longest IS NULL OR 100 * longest < 80 * w.a
QUALIFY rank <= 2000
"""
