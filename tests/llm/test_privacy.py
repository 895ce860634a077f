"""Personal information: every kind in several spellings, look-alikes, names learned from the corpus, readable results."""

from engrava.llm import privacy

ENTITIES = [("Elena Kerrnak", "[PERSON_1]"), ("Omar Thornmere", "[PERSON_2]"), ("Amber Lantern", "[PROJECT_1]")]
CASES = {
    "email": ["Mail: anna.b@example.com now", "send to hugo at oakpost dot test today", "x: petra[at]mail.example.org", "请发到lukas＠example.net谢谢"],
    "phone": ["Call (555) 019-9544 after five", "ring +44 7700 900586", "手机号是199-0000-1695。", "Bitte 0049 30 23125 149 anrufen", "Phone: 555-0162 today", "Text 07700 900442"],
    "id_number": ["my passport ZB 048 5014 please", "SSN 917-40-9401", "Personalausweis L15472443.", "driving licence JAST351964AY", "证件号码998725195305056123，请保密", "护照E25336403"],
    "address": ["We met at 1437 Bramble Ave., Wexholm and left", "Ich wohne in Gerberallee 82b, 04163 Oderthal.", "地址：临溪市石桥区银杏巷378号6栋。", "to Flat 3, 1279 Mill Road, Fallowton last"],
    "name": ["Thanks to Elena Kerrnak.", "OMAR THORNMERE signed", "Thornmere, Omar", "Dr. Kerrnak", "E. Kerrnak wrote", "negotiated by Elena Wendova", "elena m. wendova"],
}
CLEAN = [
    "Order 551-4481-32 shipped in batch nine.", "Error code 534-10-9576 is harmless.", "Der Lauf 489-9698 ist fertig.", "ISBN-like code 000-2-861-9457-2 is a sample.", "The window runs from 2024-08-18 to 2024-08-28.",
    "scp build@runner-8:/srv/x", "queue holds 189 items, none for @all.", "Street View tiles fill 683 of the 900 slots.", "Passport to Amber Lantern is the title of the deck.", "Lane 12 of the Harrow pipeline is slow.",
    "elena-kerrnak.md was moved", "Elena said yes", None, "", "a" * 100000, "some plain words said " * 3000,
]


def test_kinds_and_text(spark):
    rows = [(f"{k}{i}", t, "x") for k, ts in CASES.items() for i, t in enumerate(ts)] + [(f"clean{i}", t, "x") for i, t in enumerate(CLEAN)]
    rows += [("dup", CASES["email"][0], "y")] * 2
    records = spark.createDataFrame(rows, "rec_id string, content string, entity string")
    entities = spark.createDataFrame(ENTITIES, "entity string, placeholder string")
    out = privacy.sanitise(records, entities).collect()
    got = {r.rec_id: set(r.kinds) for r in out}
    want = {f"{k}{i}": {k} for k, ts in CASES.items() for i in range(len(ts))} | {"dup": {"email"}}
    assert got == want and len(out) == len(want) + 1
    text = {r.rec_id: r.clean for r in out}
    assert text["email1"] == "send to [EMAIL] today" and text["phone0"] == "Call [PHONE] after five" and text["name0"] == "Thanks to [NAME]."


def test_nothing(spark):
    records = spark.createDataFrame([], "rec_id string, content string")
    entities = spark.createDataFrame([], "entity string, placeholder string")
    assert privacy.sanitise(records, entities).count() == 0


def test_names_of_one_word_and_short_texts(spark):
    entities = spark.createDataFrame([("王小明", "[PERSON_1]"), ("Cher", "[PERSON_2]"), ("Anna Schmidt", "[PERSON_3]"), ("王小", "[PERSON_4]"), ("", "[PERSON_5]"), (None, "[PERSON_6]")], "entity string, placeholder string")
    texts = {1: "今天王小明来了", 2: "I met Cher, then left", 3: "Cherry pie", 4: "王小明", 5: "İstanbul: Anna Schmidt came", 6: "ok", 7: "Wu", 8: "王小说"}
    got = {r.rec_id: r.clean for r in privacy.sanitise(spark.createDataFrame([(str(k), v) for k, v in texts.items()], "rec_id string, content string"), entities).collect()}
    assert got == {"1": "今天[NAME]来了", "2": "I met [NAME], then left", "4": "[NAME]", "5": "İstanbul: [NAME] came", "8": "[NAME]说"}


def test_names_reveal_further_names(spark):
    texts = ["Elena Kerrnak wrote."] * 3 + ["Elena Wen wrote."] * 3 + ["Tarek Wen wrote."] * 3 + ["Tarek Li wrote."] * 3 + ["Plain words about the plan of the week and the work on it."] * 1200
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rec_id string, content string")
    entities = spark.createDataFrame([("Elena Kerrnak", "[PERSON_1]")], "entity string, placeholder string")
    assert {r.rec_id for r in privacy.sanitise(rows, entities).collect()} == {str(i) for i in range(12)}
    given, surnames = privacy.disclosure(rows.select("content"), ["Elena Kerrnak"])
    assert given == {"elena", "tarek"} and surnames == {"kerrnak", "wen", "li"}
    assert (given, surnames) == privacy.disclosure(rows.select("content"), ["Elena Kerrnak"], max_terms=8)


def test_quick_marks_lose_nothing():
    texts = [t for kind in ("id_number", "address") for t in CASES[kind]]
    texts += [c + " 12345678" for c in "passport|reisepass|ssn|social security|driving license|driver's licence|licence no|führerschein|tax id|taxpayer id|steuer-id|steuernummer|national identity|identity card|id card|ausweis|health insurance number|versicherungsnummer|national insurance|NI number|ni no|证件|身份|护照|社保|税号|驾照|驾驶证|医保".split("|")]
    texts += [f"Ort{p} 12" for p in "straße strasse str. weg platz allee gasse ring ufer damm steig chaussee".split()] + ["12b Mill Lane, Wexholm", "Am alten Markt 3 b, 04163 Oderthal"]
    for plain in texts:
        for t in (plain, plain.upper(), plain.replace("s", "ſ"), plain.replace("i", "İ"), plain.replace("i", "ı")):
            low = privacy._folded(t)
            assert privacy._id_numbers(t, low) or not any(sum(c.isdigit() for c in m.group(1)) >= 6 for m in privacy.ID_NUMBER.finditer(t))
            assert set(privacy._addresses(t, low)) >= {p for p in privacy.ADDRESS if p.search(t)}
        assert privacy.fixed_spans(plain)
    for t in ("my passport is new", "the street is long", "the ring of build12345678 is closed"):
        assert not privacy._id_numbers(t, t) and not [*privacy._addresses(t, t)]
