from tidemark.llm import licenses


def test_normalised():
    assert licenses.normalised("  Licensed under the Apache License, Version 2.0") == ("licensed under the apache license version <v>", "2.0")
    assert licenses.normalised("Licensed under CC BY-NC 4.0.")[0] == "licensed under cc by nc <v>"


def test_rules_in_order():
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES)
    ids = [(x, "") for x in ("BsdSource", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdGrant", "BsdSource", "BsdBinary", "AllRights")]
    assert scanner.licences(ids) == ["BSD-3-Clause", "BSD-2-Clause", "Proprietary"]
    assert scanner.licences([("ApacheRef", "2.0"), ("ApacheComply", ""), ("ApacheCopy", "2.0"), ("ApacheRef", "1.1")]) == ["Apache-2.0", "Apache-1.1"]
    for name, texts in licenses.SENTENCES.items():
        for text in texts:
            assert [x for x, _ in scanner.identify(f"before.\n** {text.upper().replace('<V>', '3.0')}. after")] == [name]


def test_scan(spark):
    long = "word " * 30_000 + "\nReleased under the MIT License.\n" + "tail. " * 1000
    rows = [(1, "Intro. Licensed under CC BY-NC 4.0. More!\nAll rights reserved."), (2, None), (3, ""), (4, long), (4, long), (None, "Notlicensed under CC BY 4.0."), (6, "É licensed under cc by 4.0")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, licences string, row_id int")
    got = sorted(((r["doc_id"], r["sentence_ids"], r["licences"]) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, ["CcByNc", "AllRights"], ["CC-BY-NC-4.0", "Proprietary"]), (2, [], []), (3, [], []), (4, ["MitRef"], ["MIT"]), (4, ["MitRef"], ["MIT"]), (None, [], []), (6, [], [])], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0
