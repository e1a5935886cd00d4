import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, row string, spans int, _part int, _prior int, _media int, _n int, _of int, _row int, _h int, _copy int"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Rows of documents as a table of several files, with nulls and clashing column names."""

    def make(rows, parts=3):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, *(("en", "a")[len(r) - 2 :] if len(r) < 4 else ()), None, "x", "y", None, 7, *range(8)) for r in rows]
        path = str(tmp_path_factory.mktemp("docs") / "t")
        spark.createDataFrame(full, DOCS).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose with copies, near copies, shared passages and repeated lines."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeiorst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = text(60), text(14)
    docs = [text(rng.randrange(5, 150)) for _ in range(60)]
    docs += [docs[1]] * 6 + [docs[2].upper(), docs[3] + "\n\t" + line]
    for base in docs[4:9]:
        for _ in range(5):  # near copies
            w = base.split(" ")
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    docs += [text(20) + " " + passage + " " + text(30) for _ in range(8)]
    docs += [line + "\n" + text(12) for _ in range(12)] + [(line + "\n") * 30, text(4000), text(3), "a", "", None, " \t\n", "ÄÖü ßé " * 5, "\U0001f600 smile \U0001f600"]
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]
