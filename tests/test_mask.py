"""Masking end to end: exact strings, sequential rules, literals, entities, modes."""

from pyspark.sql import functions as F

from pseudoflow.operators import mask as M
from pseudoflow.operators import unmask as U
from pseudoflow.options import MaskOptions


def masked(spark, text, **opts):
    lits = opts.pop("literals_col_value", None)
    ents = opts.pop("entities", None)
    df = spark.createDataFrame([(1, text, lits)], "doc_id int, text string, lits array<string>")
    kw = {}
    if lits is not None:
        kw["literals_col"] = "lits"
    if ents is not None:
        e = spark.createDataFrame([(1, 0, i, t, v) for i, (t, v) in enumerate(ents)],
                                  "doc_id int, chunk_no int, entity_no int, type string, value string")
        res = M.pseudonymize(df, MaskOptions(**opts), entities=e, **kw)
    else:
        res = M.mask_rows(df, options=MaskOptions(**opts), **kw)
    row = res.masked.first()
    restored = U.unmask(res.masked, res.mapping).first().restored_text
    return row.masked_text, restored


def test_polish_exact(spark):
    assert masked(spark, "nr PESEL: 90010112318", lang="pl", engines="regex")[0] == "nr PESEL: [PESEL:1]"
    assert masked(spark, "NIP: 526-000-00-05", lang="pl", engines="regex")[0] == "[NIP:1]"
    assert masked(spark, "NIP: 526-000-00-00", lang="pl", engines="regex")[0] == "NIP: 526-000-00-00"
    out, back = masked(spark, "Tel1: 601 234 567, Tel2: 512 345 678", lang="pl", engines="regex")
    assert out == "Tel1: [PHONE:1], Tel2: [PHONE:2]" and back == "Tel1: 601 234 567, Tel2: 512 345 678"


def test_combined_documents_round_trip(spark):
    pl = ("Szanowny Kliencie (nr PESEL: 90010112318, NIP: 526-000-00-05), prosimy o przelew na konto "
          "61 1090 1014 0000 0712 1981 2874. Kontakt: 601 234 567 lub biuro@firma.pl")
    out, back = masked(spark, pl, lang="pl", engines="regex")
    for tag in ("PESEL", "NIP", "IBAN", "PHONE", "EMAIL"):
        assert f"[{tag}:1]" in out
    assert back == pl
    en = ("Dear John (SSN: 123-45-6789), please charge card 4111 1111 1111 1111. "
          "Call (555) 123-4567 or email john@company.com.")
    out, back = masked(spark, en, lang="en", engines="regex")
    assert out == ("Dear John (SSN: [SSN:1]), please charge card [CREDIT_CARD:1]. "
                   "Call [PHONE:1] or email [EMAIL:1].")
    assert back == en


def test_rejected_card_lets_phone_match(spark):
    out, _ = masked(spark, "555-123-4567 555-123-4567", lang="en", engines="regex")
    assert out == "[PHONE:1] [PHONE:1]"


def test_strict_off_masks_invalid_ssn(spark):
    assert masked(spark, "SSN: 900-12-3456", lang="en", engines="regex", strict_validation=False)[0] == "SSN: [SSN:1]"
    assert masked(spark, "SSN: 900-12-3456", lang="en", engines="regex")[0] == "SSN: 900-12-3456"


def test_literals_case_insensitive_keep_matched_text(spark):
    out, back = masked(spark, "JAN KOWALSKI podpisał umowę.", lang="pl", engines="regex",
                       custom_literals=("jan kowalski",))
    assert out == "[CUSTOM:1] podpisał umowę." and back.startswith("JAN KOWALSKI")


def test_row_literals_and_longest_first(spark):
    out, _ = masked(spark, "Jan Kowalski and Jan", lang="en", engines="regex", literals_col_value=["Jan", "Jan Kowalski", ""])
    assert out == "[CUSTOM:1] and [CUSTOM:2]"


def test_entities_longest_first_and_absent(spark):
    text = ("Tomasz Kowalski złożył pozew przeciwko BNP Paribas Bank Polska S.A. Reprezentuje go "
            "radca prawna Anna Nowakowska z kancelarii Nowakowska & Partnerzy.")
    ents = [("PERSON", "Tomasz Kowalski"), ("PERSON", "Anna Nowakowska"), ("ORG", "BNP Paribas Bank Polska S.A."),
            ("ORG", "Nowakowska & Partnerzy"), ("ORG", "Absent Corp")]
    out, back = masked(spark, text, lang="pl", engines="hybrid", entities=ents)
    for tok in ("[PERSON:1]", "[PERSON:2]", "[ORG:1]", "[ORG:2]"):
        assert tok in out
    assert "[ORG:3]" not in out and back == text


def test_entity_inside_word_and_repeats(spark):
    out, _ = masked(spark, "Anna Nowak powiedziała, że Anna Nowak wróci.", lang="pl", engines="hybrid",
                    entities=[("PERSON", "Anna Nowak")])
    assert out.count("[PERSON:1]") == 2


def test_mask_by_row_language(spark):
    df = spark.createDataFrame([(1, "pl", "PESEL 90010112318"), (2, "en", "SSN 123-45-6789"), (3, "de", "SSN 123-45-6789")],
                               "doc_id int, lang string, text string")
    res = M.mask_rows(df, options=MaskOptions(engines="regex"), lang_col="lang")
    got = {r.doc_id: r.masked_text for r in res.masked.collect()}
    assert got == {1: "PESEL [PESEL:1]", 2: "SSN [SSN:1]", 3: "SSN [SSN:1]"}


def test_literal_candidate_filter_is_exact(spark):
    # Kelvin sign and long s match ASCII k / s under (?iu); the pre-check must keep those literals
    text = "Kate and \u017fam and \u212aATE"
    out, back = masked(spark, text, lang="en", engines="llm", custom_literals=("kate", "sam", "absent"))
    # literal rank first ("kate" before "sam"), then position
    assert out == "[CUSTOM:1] and [CUSTOM:3] and [CUSTOM:2]"
    assert back == text
