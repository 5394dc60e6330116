"""Small documents for all operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, label int, size string, part double"


def texts(seed=7, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeghinorst") for _ in range(r.randint(1, 7))) for _ in range(150)]
    out = []
    for _ in range(n):
        out.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 12, 13, 14, 40, 80, 200]))))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for k in range(6):  # a shared passage, exact and near copies
        out.append(f"{out[k + 10]}\n{passage} {out[k + 20]}")
        out.append(out[-1] + " end")
        out.append(out[-2])
    out += ["", " \t\n ", "It's ÉTÉ\x0bin\x1cone 漢字 İ K a b", "X " * 3000, passage, passage.upper()]
    return out


def rows(seed=7):
    r = random.Random(seed)
    out = []
    for i, t in enumerate(texts(seed)):
        out.append((i, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "b", None]), len(t), "x", 1, "y", 0.5))
    out += [(900, None, "en", "src0", None, "x", 1, "y", 0.5), (None, out[3][1], "en", None, 3, "x", 1, "y", 0.5), (None, None, None, None, None, None, None, None, None)]
    out += [out[30], out[30], out[61]]
    r.shuffle(out)
    return out


def documents(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)


def found_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(row):
    return tuple((x is not None, x) for x in row)
