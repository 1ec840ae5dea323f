"""Documents with nulls, blanks, long texts, ties and repeated rows, and plain Python versions
of what the operators compute."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import functions as F

WS = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, to clash with.
CLASHES = ("key", "node", "size", "slot", "shard", "kept", "n_words", "text_hash", "_text_hash", "words", "score", "start", "ids", "_id",
           "_hash", "_source", "_size", "_words", "curve", "_text_hash_0", "document", "label", "first", "component", "_bytes")


def words(n: int, seed: int = 0, kinds: int = 400) -> list[str]:
    return [f"w{zlib.crc32(f'{seed}/{i}'.encode()) % kinds}" for i in range(n)]


def odd_texts() -> list[str | None]:
    base = words(120)
    near = base[:]
    near[60] = "other"
    return [
        None, "", "  \n\t ", "one", "one two three", " ".join(base), " ".join(base), " ".join(near), " ".join(base[:119]),
        " ".join(words(3000, 5, 5000)), "a b c\x1cd Été \U0001F600 <|endoftext|> it's 555-5817 x́y", "same same same same same same " * 30,
        "Line one is here.\nLine one is here.\n#*$ Other line!! A B C\r\n", " ".join(words(40, 9)), " ".join(words(41, 9)),
    ]


def documents(spark, texts=None, clash: bool = False):
    texts = odd_texts() if texts is None else texts
    rows = [(i * 3 + 7, t, ("en", "de", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in CLASHES if clash else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> set:
    found = re.findall(WS, ascii_lower(text))
    if not found:
        return set()
    k = min(5, len(found))
    return {tuple(found[i:i + k]) for i in range(len(found) - k + 1)}


def components(rows: list[tuple[int | None, str | None]]) -> list[int | None]:
    """The smallest id reachable, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(rows))]


def repeat_words(text: str | None) -> int:
    found = re.findall(WS, text or "")
    seen: dict[tuple, list[int]] = {}
    for i in range(len(found) - 7):
        seen.setdefault(tuple(found[i:i + 8]), []).append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    return len(hit)


def benchmark_hits(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[str]]:
    """Words, words hit, item ids as sorted strings."""
    found = re.findall(LETTERS, ascii_lower(text))
    hit, ids = set(), set()
    for item, body in items:
        own = re.findall(LETTERS, ascii_lower(body))
        n = min(13, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            for i in range(len(found) - n + 1):
                if found[i:i + n] == own[s:s + n]:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
    return len(found), len(hit), sorted(ids)
