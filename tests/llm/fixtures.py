"""Small tables with every awkward case, and SF tables."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["g", "b", "data", "kept", "rest", "n", "n_removed", "node", "component", "bands", "shard", "score", "predicted", "length", "cluster", "part", "media", "ids", "u", "v", "a", "hash"]


def texts(seed=7, n=40):
    """Texts of few words with copies, near copies, shared passages and lines, empty ones and a long one."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["ü", "漢字", "🙂", "it's", "a,b"]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, lines = line(60), [line(5) for _ in range(4)]
    out = [line(rnd.randint(1, 120)) for _ in range(n)]
    out += [out[0], out[0], out[3] + " more", passage, f"{line(20)} {passage} {line(9)}", f"{passage}\n{line(3)}"]
    out += ["\n".join(lines), "\n".join([line(3), *lines, line(2)]), "\n".join(lines[1:] + lines)]
    base = line(150).split(" ")
    for i in range(8):
        out.append(" ".join(w if j != 11 + i * 15 else f"edit{i}" for j, w in enumerate(base)))
    out += ["", "", " ", "\n\n\n\n\n", "a", "a b c", "x" * 5000, "ab " * 4000, "  two  spaces \t tab\r\n end ", "the idiot and you moron", "\x00nul\x00"]
    return out


def docs(spark, seed=7):
    """The texts with doc_ids in another order, a repeated row, a repeated doc_id, and nulls in every column."""
    t = texts(seed)
    ids = list(range(len(t)))
    random.Random(seed).shuffle(ids)
    rows = [(i, x, "en", f"s{i % 3}" if i % 4 else "hot", len(x)) for i, x in zip(ids, t)]
    rows += [rows[1], (rows[2][0], "another text of the same id", None, None, None), (900, None, None, None, None), (None, t[5], None, "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(frame):
    """The same rows with more columns, named as operators might name theirs."""
    return frame.select("*", *(F.lit(1).alias(c) for c in CLASHING if c not in frame.columns))


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)
