"""Small tables with everything that is odd about rows, and plain versions of what operators compute."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, `key` string, `row` int, `c0` int, token int, "
          "salt string, label int, `a.b` string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def odd_rows():
    """Nulls in every column, empty, white and very long texts, ties, repeated rows, clashing column names."""
    base, long = prose(1, 120), prose(2, 30_000)
    texts = [None, "", " \t\n ", "word", "two words", base, base, base.replace(" ", "  ", 1), base + " end", long, long + " x", "é ü\x0bö ñ", "a\nb\n"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "k", 1, 2, 3, "s", None, "x")
            for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append(rows[6])  # a repeated row
    rows.append(rows[0])
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def similar(a, b, percent):
    common = len(a & b)
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)
