"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words one edit apart have letter counts at a squared distance of 1 (one letter more) or 2 (another letter), so words are
blocked by their lengths and, within a length, by how many letters they have of each of a few groups of letters: an edit
moves one letter between two groups, or adds one to a group, so each block is held against the few adjacent ones
only. In a task the product of two blocks' count matrices gives all squared distances; pairs at the right one are verified
letter by letter. Blocks are cut into tiles of bounded size, and of a pair of tiles only each word's number of near words
and its best one leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut, forget

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
"""Words have at least so many letters and occurrences; a form occurs at least so many times as often."""
DAMAGE = 31
GROUPS = 5
"""Groups of letters, by code point modulo this: more make blocks smaller and their pairs more."""
TILE = 32_768
"""Letters of a tile, about."""
PRODUCT = 4_000_000
"""Numbers of a product that are made at a time."""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))


def occurrences(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """``(word)``: every maximal run of letters of the texts, A-Z in lower case, that can give a word long enough.

    Where the check sum of ``doc_id:run`` is divisible by ``damage`` the run loses a letter, at the check sum modulo its length.
    A null doc_id counts as an empty one, a null text has no runs.
    """
    runs = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("([a-zÀ-ÿ]{%d,})" % LEAST_LETTERS), 1)).alias("run")
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs)
    own = own.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return own.select(F.when(F.col("h") % damage == 0, without).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that occur at least so often; counts are summed in each task before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letter_counts(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    cells = (np.arange(n) * 256)[:, None] + x
    return np.bincount(cells.ravel(), minlength=n * 256).reshape(n, 256).astype(np.float32 if size < 2000 else np.float64)


def near_pairs(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` (a word a row, as Latin-1; y's of equal length or one longer) of words one edit apart; ``same``: both are one tile, pairs are told once."""
    far = 2 if x.shape[1] == y.shape[1] else 1
    a, b = _letter_counts(x), _letter_counts(y)
    used = np.flatnonzero(a.any(0) | b.any(0))
    a, b = a[:, used], b[:, used]
    # (counts, norm, 1) times (-2 counts, 1, norm) is the squared distance
    left = np.column_stack((a, (a * a).sum(1), np.ones(len(a), a.dtype)))
    right = np.column_stack((-2 * b, np.ones(len(b), b.dtype), (b * b).sum(1))).T
    out = []
    step = max(1, PRODUCT // max(1, len(y)))
    for k in range(0, len(x), step):
        i, j = np.nonzero(left[k : k + step] @ right == far)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        some = max(1, PRODUCT // x.shape[1])
        for m in range(0, len(i), some):
            p, q = i[m : m + some], j[m : m + some]
            u, v = x[p], y[q]
            if far == 2:
                ok = (u != v).sum(1) == 1
            else:
                ahead, behind = np.column_stack((u != v[:, :-1], np.ones(len(u), bool))), np.column_stack(((u != v[:, 1:])[:, ::-1], np.ones(len(u), bool)))
                ok = ahead.argmax(1) + behind.argmax(1) >= u.shape[1]
            out.append((p[ok], q[ok]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), ())))


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with near ones, how many, and the near one of largest n (first among equals; a tile is in order)."""
    order = np.lexsort((other, -n[other], own))
    word, first, count = np.unique(own[order], return_index=True, return_counts=True)
    return word, count, other[order][first]


def near_words(vocab: DataFrame, groups: int = GROUPS, tile: int = TILE) -> DataFrame:
    """``(word, n_near, form, form_n)`` of the words of ``vocab(word, n)`` that have words one edit apart: how many, and the most frequent (ties: the first)."""
    members = ["".join(c for c in _LETTERS if ord(c) % groups == k) for k in range(groups)]
    g = [f"g{k}" for k in range(groups)]
    words = vocab.select("word", "n", F.length("word").alias("size"), *((F.length("word") - F.length(F.translate("word", m, ""))).alias(c) for c, m in zip(g, members)))
    cells = words.groupBy(*g).agg(F.ceil(F.count("*") * F.max("size") / tile).alias("tiles"))
    rows = F.array_sort(F.collect_list(F.struct("word", "n")))
    tiles = words.join(cells, g).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles"))).groupBy(*g, "tile").agg(rows.alias("w"))
    tiles = cut(tiles.select(*g, "tile", F.array_join(F.transform("w", lambda x: x.word), "").alias("words"), F.transform("w", lambda x: x.n).alias("n")))
    # what a word's block has more or less of than the block it is held against
    steps = [[0] * groups] + [[(k == p) - (k == q) for k in range(groups)] for q, p in combinations(range(groups), 2)] + [[int(k == p) for k in range(groups)] for p in range(groups)]
    name = lambda step: F.concat_ws(".", *(F.col(c) - s for c, s in zip(g, step)))
    right = tiles.select(F.explode(F.array(*(F.struct(name(s).alias("cell"), F.lit(not any(s)).alias("own")) for s in steps))).alias("to"), F.col("tile").alias("tile_y"), F.col("words").alias("y"), F.col("n").alias("ny"))
    left = tiles.select(name([0] * groups).alias("cell"), F.col("tile").alias("tile_x"), F.col("words").alias("x"), F.col("n").alias("nx"))
    pairs = left.join(right.select("to.cell", "to.own", "tile_y", "y", "ny"), "cell").where("not own or tile_x <= tile_y")
    pairs = pairs.select("x", "nx", "y", "ny", (F.col("own") & (F.col("tile_x") == F.col("tile_y"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                text = [one.column(c)[0].as_py() for c in (0, 2)]
                n = [one.column(c).flatten().to_numpy() for c in (1, 3)]
                sides = [np.frombuffer(t.encode("latin-1"), np.uint8).reshape(len(m), -1) for t, m in zip(text, n)]
                i, j = near_pairs(*sides, one.column(4)[0].as_py())
                both = [(0, i, 1, j), (1, j, 0, i)] if len(i) else []
                if both and one.column(4)[0].as_py():  # one tile: its words are on both sides
                    both = [(0, np.append(i, j), 0, np.append(j, i))]
                for a, own, b, other in both:
                    size, near_size = sides[a].shape[1], sides[b].shape[1]
                    word, count, form = _best(own, other, n[b])
                    out[0] += [text[a][w * size : (w + 1) * size] for w in word.tolist()]
                    out[1] += count.tolist()
                    out[2] += [text[b][w * near_size : (w + 1) * near_size] for w in form.tolist()]
                    out[3] += n[b][form].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "form", "form_n"])

    found = pairs.mapInArrow(compare, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("b"))
    return best.select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: forms followed to the last, twice as far each round. Forms grow tenfold at each step, so a chain is short."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old, now = now, cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(old)
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of ``docs(doc_id, text)``.

    The form of a word is the near word that occurs most, if at least ``times`` as often as itself; else form and form_n are
    null and the word is its own root. Repeated rows count like others, other columns are not looked at, and an empty
    table gives no row.
    """
    vocab = cut(vocabulary(occurrences(docs)))
    all_near = vocab.join(near_words(vocab), "word", "left")
    has = F.col("form_n") >= times * F.col("n")
    out = cut(all_near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of ``documents``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL: near words share a deletion or a replaced letter's place; roots by recursion."""
    return r"""WITH RECURSIVE tb AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
rn AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS r FROM documents),
rc AS (SELECT d, r, count(*) AS k FROM rn GROUP BY ALL),
hx AS (SELECT r, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(d || ':' || r, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + unicode(ch)::BIGINT // 64, 128 + unicode(ch)::BIGINT % 64] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM rc, tb),
wd AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, k FROM hx),
vc AS (SELECT w, sum(k)::BIGINT AS n FROM wd WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
pl AS (SELECT w, n, unnest(range(length(w))) AS p FROM vc),
wc AS (SELECT w, n, substr(w, 1, p) || '*' || substr(w, p + 2) AS k FROM pl),
dl AS (SELECT DISTINCT w, n, substr(w, 1, p) || substr(w, p + 2) AS k FROM pl),
nr AS (SELECT a.w, b.w AS o, b.n AS m FROM wc a JOIN wc b ON a.k = b.k AND a.w <> b.w UNION SELECT d.w, v.w, v.n FROM dl d JOIN vc v ON v.w = d.k UNION SELECT v.w, d.w, d.n FROM dl d JOIN vc v ON v.w = d.k),
bs AS (SELECT w, count(*) AS n_near, min(struct_pack(less := -m, o := o)) AS b FROM nr GROUP BY w),
fm AS (SELECT vc.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN b.o END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n FROM vc LEFT JOIN bs ON bs.w = vc.w),
ch(w, root) AS (SELECT w, form FROM fm WHERE form IS NOT NULL UNION ALL SELECT ch.w, fm.form FROM ch JOIN fm ON fm.w = ch.root WHERE fm.form IS NOT NULL),
lt AS (SELECT ch.w, root FROM ch JOIN fm ON fm.w = ch.root WHERE fm.form IS NULL)
SELECT fm.w AS word, form, coalesce(lt.root, fm.w) AS root, n, n_near, form_n::BIGINT AS form_n FROM fm LEFT JOIN lt ON lt.w = fm.w"""
