"""Quality rules and PII: edge cases; whole tables are compared with SQL in test_entry."""

import hashlib
import random
import re
import textwrap

from pyspark.sql import functions as F

from casekit.llm import pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    words = WORD.findall(text or "")
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    cover = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return (len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), len(cover), failed)


def test_quality_base_against_brute_force(docs_of):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h " * 4, "x\ny\nx\n\n x\n", "é#$ ü|<> ナ \x0b w\x0c z"]
    for _ in range(40):
        texts.append("".join(rng.choice(["aa ", "b ", "cc\n", "d, ", "#e\t", "f. "]) for _ in range(rng.randint(0, 60))))
    df = docs_of(list(enumerate(texts))).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality.quality_rules(df).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_verdicts(docs_of):
    prose = " ".join(f"Sentence number {i} tells something of its own." for i in range(12))
    menu = "\n".join(f"Home{i} | News{i} | About{i} | Shop{i}" for i in range(30))
    shout = " ".join(f"BUY{i}!!" for i in range(40))
    stutter = " ".join(f"word{i} " * 6 for i in range(10))
    rows = {1: prose, 2: menu, 3: shout, 4: prose + "\nAll rights reserved.", 5: stutter, 6: prose.upper()}
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(rows.items())).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5, 6)] == [True, False, False, True, False, True]
    assert got[4].clean_text == prose and got[1].clean_text == prose


def test_quality_keeps_hard_wrapped_prose(docs_of):
    english = ("The old harbour master walked along the quay every morning before the boats came in and wrote down the names of all "
               "the crews who had been out during the night while his brother James Porter from Bristol counted the crates of fish that "
               "were brought ashore and sold them to the merchants who had been waiting there since the early hours of the day.")
    german = ("Der alte Meister ging an jedem Morgen an der Mauer entlang und schrieb mit seiner Feder die Namen der Boote auf, die in der "
              "Nacht auf See gewesen waren, bevor die Frauen der Fischer mit ihren Karren und den schweren Kisten voller Heringe zum Markt "
              "im Zentrum der Stadt fuhren und dort auf die Kunden aus den Bergen warteten.")
    hindi = "\n".join(["यह नदी पहाड़ों से निकल कर मैदानों की ओर बहती है और किनारे के गाँवों को"] * 2 + ["पानी देती है।"])
    rows = {10 * k + i: textwrap.fill(t, width) for k, width in enumerate((60, 72, 100)) for i, t in enumerate((english, german))}
    rows |= {50: english.replace(" and ", " and\r\n"), 51: hindi, 52: "क्या यह ठीक है؟\nयह ठीक है।"}
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(rows.items())).collect()}
    assert {i: r.lost_chars for i, r in got.items()} == dict.fromkeys(rows, 0)
    assert all(got[i].kept and got[i].clean_text == t for i, t in rows.items() if i < 50)


def test_quality_still_drops_links_and_headings_around_prose(docs_of):
    prose = textwrap.fill(" ".join(f"Sentence number {i} tells something long enough of its own to be wrapped" for i in range(12)) + ".", 72)
    junk = ["Home", "About us", "Latest News From Our Correspondents Around The World Today", "contact", "imprint", "Login Here", ""]
    got = quality.quality_rules(docs_of([(1, "\n".join([*junk, prose, "", *junk]))])).first()
    assert got.clean_text == prose


def test_quality_long_text_repeated_rows_and_empty_table(docs_of):
    long = " ".join(f"w{i % 997}x{i}" for i in range(60000)) + "."
    got = quality.quality_rules(docs_of([(1, long), (1, long), (None, long)])).collect()
    assert len(got) == 3 and {r.n_words for r in got} == {60000} and {r.n_repeat_words for r in got} == {0}
    assert quality.quality_rules(docs_of([])).collect() == []


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, pat) in enumerate(BASE):
        for m in re.finditer(pat, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_pii_base_against_brute_force(docs_of):
    rng = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999", "+49", " ", "é", "\n", "-",
            "4539 5787 6362 1486", "4539578763621486", "4539578763621487", "007.08.9.1", "a@b.c_d@e.f", "99999999999999999999", "@@", "日本"]
    texts = [None, "", "a" * 5000 + "@", "1." * 3000, "a.b@" + "c." * 3000 + "d", "1 " * 4000] + [
        "".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    rows = pii.digest(pii.find_pii(docs_of(list(enumerate(texts))).withColumn("start", F.lit(1)))).collect()
    got = {r.doc_id: r.base_sha256 for r in rows}
    assert got == {i: hashlib.sha256(brute_pii(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_pii_method_kinds_context_and_redaction(docs_of):
    rows = {1: "IBAN GB82 WEST 1234 5698 7654 32 here", 2: "GB82WEST12345698765433 wrong check", 3: "his ssn is 123-45-6789 ok",
            4: "part 123-45-6789 of a list", 5: "write a@b.co, 1.2.3.4 or +1 555 010 9999.", 6: "nothing", 7: "é a@b.co a@b.co"}
    df = pii.find_pii(docs_of(rows.items()))
    spans = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert spans[1] == "iban:5:32" and spans[2] == "" and spans[3] == "ssn:11:22" and spans[4] == "" and spans[6] == ""
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[5] == "write [EMAIL], [IP] or [PHONE]." and masked[6] == "nothing" and masked[7] == "é [EMAIL] [EMAIL]"
    assert masked[1] == "IBAN [IBAN] here"


def test_pii_account_numbers_before_capitals_and_digits(docs_of):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    rows = {1: "IBAN DE89370400440532013000 Thanks", 2: "DE89370400440532013000 EUR 250", 3: f"{de} BIC COBADEFF", 4: f"{gb} I paid",
            5: f"{de} {gb} 98", 6: f"AB12 CODE {de} OK", 7: f"X{de}", 8: "DE89370400440532013000x", 9: f"({de})", 10: f"é {gb}, AND {de} 7",
            11: "NO93 8601 1117 947 NO93 8601 1117 947", 12: "DE88370400440532013000 EUR 250"}
    df = pii.find_pii(docs_of(rows.items()))
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked == {
        1: "IBAN [IBAN] Thanks", 2: "[IBAN] EUR 250", 3: "[IBAN] BIC COBADEFF", 4: "[IBAN] I paid", 5: "[IBAN] [IBAN] 98",
        6: "AB12 CODE [IBAN] OK", 7: rows[7], 8: rows[8], 9: "([IBAN])", 10: "é [IBAN], AND [IBAN] 7", 11: "[IBAN] [IBAN]", 12: rows[12]}


def test_pii_many_matches_and_empty_table(docs_of):
    text = " ".join(f"u{i}@h.io" for i in range(700))
    got = pii.digest(pii.find_pii(docs_of([(1, text), (1, text)]))).collect()
    assert [r.n_email for r in got] == [700, 700] and len({r.base_sha256 for r in got}) == 1
    assert got[0].base_sha256 == hashlib.sha256(brute_pii(text).encode()).hexdigest()
    assert pii.digest(pii.find_pii(docs_of([]))).collect() == []
