import os
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from catalith.llm import chat, licences


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash")).withColumn("better", F.lit(1))
    out = chat.preference_pairs(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)
    return {r.pair_id: r for r in out.collect()}


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_common_prefix_is_the_prompt(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why")]
    r = pairs(spark, rows)[0]
    assert (r.n_prompt_turns, r.prompt) == (1, turn("user", "hi"))
    assert r.chosen == turn("assistant", "good") and r.rejected == turn("assistant", "bad") + turn("user", "why")
    runs = [tuple(map(int, x.split(":"))) for x in r.rejected_mask.split(",")]
    assert sum(n for n, _ in runs) == len(r.rejected)
    at, learned = 0, ""
    for n, flag in runs:
        learned += r.rejected[at : at + n] * flag
        at += n
    assert learned == "bad<|im_end|>\n"


def test_odd_conversations(spark):
    rows = [
        (0, 0, "user", "a"), (1, 0, "user", "a"),  # equal
        (2, 0, "user", "a"),  # without a partner
        (4, 5, None, None), (5, 7, "", ""),  # nulls count as empty; only order matters
        (6, 0, "user", "x"), (6, 0, "user", "x"), (7, 0, "user", "x"),  # repeated rows
        (8, 0, "user", "y" * 200_000), (9, 0, "user", "y" * 200_000), (9, 1, "assistant", "z"),
        (None, 0, "user", "lost"), (10, None, "user", "lost"),
    ]
    got = pairs(spark, rows)
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert (got[0].n_prompt_turns, got[0].chosen, got[0].rejected, got[0].chosen_mask) == (1, "", "", "")
    assert (got[1].n_prompt_turns, got[1].rejected) == (0, "") and got[1].chosen == turn("user", "a")
    assert got[2].n_prompt_turns == 1 and got[2].prompt == turn("", "")
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (1, turn("user", "x"), "")
    assert got[4].n_prompt_turns == 1 and got[4].rejected == turn("assistant", "z")
    assert pairs(spark, []) == {}


def test_licences(spark):
    mit, bsd = licences.TEXTS["MIT"], licences.TEXTS["BSD-3-Clause"]
    cases = [
        (1, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license"), "MIT"),
        (2, bsd.replace("1. ", "  * ").replace("2. ", " * ").replace("3. ", "* ").replace("holder", "owner"), "BSD-3-Clause"),
        (3, "Copyright 1999 A\nAll rights reserved.\n" + licences.TEXTS["ISC"].replace(", ", ",\n\n   "), "ISC"),
        (4, mit + " and more", None), (5, None, None), (6, "", None), (7, "Released under the MIT License.", None), (7, "Released under the MIT License.", None), (8, mit * 100, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("licence", F.lit("clash"))
    got = licences.scan_licences(df).collect()
    assert sorted((r.doc_id, r.licence or "") for r in got) == sorted((i, lic or "") for i, _, lic in cases)
    assert licences.known_digests(spark).select("digest").distinct().count() == len(licences.TEXTS)
    assert licences.scan_licences(df.limit(0)).count() == 0
    assert licences.scan_licences(df, licences.known_digests(spark)).where("licence is not null").count() == 3


def found(spark, rows, known=None):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.licence for r in licences.scan_licences(df, known).collect()}


def test_every_listed_licence_however_it_is_wrapped(spark):
    names, rows, want = sorted(licences.TEXTS), [], {}
    for i, name in enumerate(names):
        for j, width in enumerate((60, 66, 72, 76, 80, 100)):
            lines = [textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in licences.TEXTS[name].split("\n")]
            text = "Copyright (c) 2019 The Foo Authors\n\n" * (j % 2) + "\n".join(lines) + "\n"
            if j % 2 and name == "WTFPL":  # its first line is its title
                continue
            rows.append((10 * i + j, text))
            want[10 * i + j] = name
    assert len(names) >= 30 and found(spark, rows) == want


def test_unlike_texts_have_unlike_digests(spark):
    df = spark.createDataFrame([(1, "MIT License"), (2, "a license"), (3, "a driving license (for cars)\nis what you need"), (4, "")], "doc_id long, text string")
    digests = {r.doc_id: r.digest for r in licences.scan_licences(df).collect()}
    assert len(set(digests.values())) == 4


def test_blank_lines_cost_time_in_proportion(spark):
    assert found(spark, [(1, licences.TEXTS["ISC"])]) == {1: "ISC"}
    began = time.perf_counter()
    rows = [(1, "\n" * 1_000_000 + licences.TEXTS["ISC"]), (2, " \n" * 500_000), (3, " " * 1_000_000), (4, "x \n" * 300_000)]
    assert found(spark, rows) == {1: "ISC", 2: None, 3: None, 4: None}
    assert time.perf_counter() - began < 30


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no folder of licences")
def test_a_folder_of_licences(spark):
    known = licences.licence_files(spark, "file:///usr/share/common-licenses")
    text = open("/usr/share/common-licenses/GPL-2", encoding="utf-8").read()
    assert found(spark, [(1, text), (2, text[:-300]), (3, "  " + text.replace("\n\n", "\n \n"))], known) == {1: "GPL-2", 2: None, 3: "GPL-2"}


def test_ids_beyond_doubles(spark):
    big = 2**53
    rows = [(c, t, r, x) for c in (big + 2, big + 3, 2 * big + 2, 2 * big + 3) for t, r, x in ((0, "user", "same"), (1, "assistant", str(c)))]
    got = pairs(spark, rows)
    assert sorted(got) == [big // 2 + 1, big + 1] and all(r.n_prompt_turns == 1 for r in got.values())
