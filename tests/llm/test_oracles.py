"""The SQL twins follow the code on rows that the given tables lack."""

import random
import textwrap

import duckdb
import pandas as pd

from casekit.llm import pii, quality

PROSE = ("The council met on Tuesday to discuss the budget for the coming year, and most members agreed that the schools should "
         "come first. Nobody spoke against the plan, although two members asked for a second reading before the vote. Repairs to "
         "the old bridge were put off again; the engineers had not finished their report in time. ")


def planted_texts():
    rng = random.Random(3)
    texts = [textwrap.fill(PROSE * k, width) for k in (1, 2, 4) for width in (40, 60, 72, 100)]
    texts += [textwrap.fill(PROSE, 60).replace("\n", "\n\n"), textwrap.fill(PROSE, 60).replace(" ", "  "), PROSE + "\n" + PROSE.upper()]
    texts += ["यह एक वाक्य है। और यह दूसरा वाक्य है।\nतीसरा वाक्य यहाँ है॥\n" * 6, "هل هذا سؤال؟\nهذه جملة أخرى۔\n" * 8, "これは文です。次の文です。\nもう一つの文！\n" * 9,
              "Սա նախադասություն է։\nሰላም ለዓለም።\n" * 8, "Home\nAbout Us\nContact\n" * 10 + PROSE, "Breaking News From The City\n" + PROSE + "\nMore Stories Like This One\n"]
    words = PROSE.split()
    for _ in range(40):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 16))) for _ in range(rng.randint(2, 14))]
        texts.append("\n".join(rng.choice([str.title, str, str, str.lower])(x) + rng.choice(["", "", ".", "?”", " |  | "]) for x in lines))
    return texts + [None, "", "\n\n", " \n x"]


def planted_numbers():
    good = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947", "DE89 3704 0044 0532 0130 00",
            "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S"]
    after = ["", " Thanks", " EUR 250", " BIC COBADEFF", " 00 12", "x", "X", "7", ".", " I paid", ", and GB82WEST12345698765432", " DE89370400440532013000", "\n"]
    before = ["", "IBAN ", "a", "Z", "7", "-", "AT12 ", "é"]
    texts = [f"{b}{g}{a}" for g in good for a in after for b in before]
    texts += [f"Pay {g[:-1]}{(int(g[-1], 36) + 1) % 10} now" for g in good] + ["AB12", "AB12 CD34 EF56 GH78", "AA00" * 20, None, ""]
    return texts + [" ".join(texts[k] for k in range(i, 600, 37)) for i in range(37)]


def compare(spark, texts, query, sql):
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(sql).df()
    got = query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).itertuples(index=False)))
    return rows(got), rows(want), got


def test_quality_sql_judges_wrapped_lines_and_other_scripts(spark):
    query = lambda df: quality.quality_rules(df).select(*quality.DIGEST)
    got, want, rows = compare(spark, planted_texts(), query, quality.oracle_sql())
    assert got == want
    assert (rows[rows.doc_id < 12].lost_chars == 0).all() and rows[rows.doc_id < 4].kept.all()  # the others repeat themselves
    without = quality.oracle_sql().replace("AND NOT runs AND NOT coalesce(before, false)", "")
    assert without != quality.oracle_sql() and compare(spark, planted_texts(), query, without)[1] != got


def test_pii_sql_finds_account_numbers_whatever_follows(spark):
    query = lambda df: pii.digest(pii.find_pii(df))
    got, want, rows = compare(spark, planted_numbers(), query, pii.oracle_sql())
    assert got == want
    assert rows.n_iban.sum() > 200 if "n_iban" in rows else rows.spans.str.count("iban:").sum() > 200
