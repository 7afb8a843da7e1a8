"""Mentions by kind and place, and surrogates."""

import pytest

from anamnesis.llm.pii import GROWING, Detector, assign_surrogates, entities_in, entity_of, female, find_mentions, redact, replace_by_surrogates, replacement, surrogate, valid_number

D = Detector(["Maruke", "Tovin", "Ostrava", "Alenzo"], ["Obrecht", "Grendahl", "Ekström"], ["Tarnwick", "Port Amber"])


def kinds(text):
    return [(k, text[a:b]) for k, a, b in D.find(text)]


@pytest.mark.parametrize("text, want", [
    ("cc <obrecht_m＠mail.foquison.example>, please", [("email", "obrecht_m＠mail.foquison.example")]),
    ("mail a.b+c (at) site.example.com now", [("email", "a.b+c (at) site.example.com")]),
    ("x[at]y[dot]example[dot]org.", [("email", "x[at]y[dot]example[dot]org")]),
    ("me at mail dot site dot example owns it", [("email", "me at mail dot site dot example")]),
    ("u%40h.test", [("email", "u%40h.test")]),
    ("Run ssh deploy@build-10 and use pkg@1.2.3", []),
    ("The @wrap decorator", []),
    ("it stays at tokravax.matovim today", []),
    ("tel: 01632 960231.", [("phone", "01632 960231")]),
    ("Call +44 (0)20 7946 0892 or (490) 555-0164", [("phone", "44 (0)20 7946 0892"), ("phone", "490) 555-0164")]),
    ('{"phone":"1-628-555-0164 ext. 62"}', [("phone", "1-628-555-0164 ext. 62")]),
    ("+49 (0)30 / 23125-289 and 01.99.00.16.67", [("phone", "49 (0)30 / 23125-289"), ("phone", "01.99.00.16.67")]),
    ("See ticket 2025-3128-8771, Order no. 808647-8172, epoch 1726717999, 192.0.2.111, 2025-01-02", []),
    ("订单号 237227798 已处理", []),
    ("request 7da6c9ae-1287-474f-a9ab-8d0987844808 failed", []),
    ("SSN 666-98-4587 and qq-74-99-47-b", [("id_number", "666-98-4587"), ("id_number", "qq-74-99-47-b")]),
    ("身份证号：990022198506143677", [("id_number", "990022198506143677")]),
    ("Passport no. XK7430915, tax Z4215-8482-M", [("id_number", "XK7430915"), ("id_number", "Z4215-8482-M")]),
    ("SKU QX-26-K is out. SKU QX-66303-K", []),
    ("I moved to 319 Umber Lane,\nTarnwick 28311 today", [("address", "319 Umber Lane,\nTarnwick 28311")]),
    ("at 45 E. Saffron Close, Apt 6C.", [("address", "45 E. Saffron Close, Apt 6C")]),
    ("64 rue Willet, 58329 Tarnwick The", [("address", "64 rue Willet, 58329 Tarnwick")]),
    ("Vinterstraße 61, Calle Penny 310, Port Amber", [("address", "Vinterstraße 61"), ("address", "Calle Penny 310, Port Amber")]),
    ("地址：云溪路182号2单元 和 青禾大道 334 号", [("address", "云溪路182号2单元"), ("address", "青禾大道 334 号")]),
    ("Main Street is only the demo. Room 14, floor 148", []),
    ("ask Maruke Obrecht, M. Obrecht or Obrecht, Maruke", [("person", "Maruke Obrecht"), ("person", "M. Obrecht"), ("person", "Obrecht, Maruke")]),
    ("负责人是K. Ekström，请 TOVIN S. GRENDAHL", [("person", "K. Ekström"), ("person", "TOVIN S. GRENDAHL")]),
    ("I am Ostrava-Alenzo Obrecht's friend", [("person", "Ostrava-Alenzo Obrecht")]),
    ("Thanks, Grendahl, Tovin\n\nObrecht, Maruke will", [("person", "Grendahl, Tovin"), ("person", "Obrecht, Maruke")]),
    ("maruke.obrecht@mail.example", [("email", "maruke.obrecht@mail.example")]),
    ("Obrechtson and Maruke alone", []),
    ("", []),
    # formats, labels and check digits that the generated tables don't hold
    ("call about 123 45 6789", [("id_number", "123 45 6789")]),
    ("passport C01234567 attached", [("id_number", "C01234567")]),
    ("passport no X1234567", [("id_number", "X1234567")]),
    ("DNI 12345678Z or 12345678A, code 12345678A", [("id_number", "12345678Z")]),
    ("my ID number, which is 135792468.", [("id_number", "135792468")]),
    ("Steuer-ID: 12 345 678 901", [("id_number", "12 345 678 901")]),
    ("cpf 529.982.247-25, not 529.982.247-26", [("id_number", "529.982.247-25")]),
    ("Maruke Obrecht; 135792468; 01632 960231", [("person", "Maruke Obrecht"), ("id_number", "135792468"), ("phone", "01632 960231")]),
    ("epoch 123456789, order no. 123-45-6789, total 135792468", []),
    ("tel: 555 0199 23, 089/1234567", [("phone", "555 0199 23"), ("phone", "089/1234567")]),
    ("Musterweg 12, 10115 Berlin", [("address", "Musterweg 12, 10115 Berlin")]),
    ("Hauptplatz 3, Wien", [("address", "Hauptplatz 3, Wien")]),
    ("String 12 and Buffer 3, via proxy 12", []),
    ("Avenida de la Paz 12; 12 bis, avenue Victor", [("address", "Avenida de la Paz 12"), ("address", "12 bis, avenue Victor")]),
    ("中山东一路12号", [("address", "中山东一路12号")]),
    ("请寄到和平路12号", [("address", "和平路12号")]),
    ("jane dot doe at gmail dot com", [("email", "jane dot doe at gmail dot com")]),
    ("Mr. John Smith; my name is Priya Natarajan", [("person", "John Smith"), ("person", "Priya Natarajan")]),
    ("Maruke Obrecht-Grendahl", [("person", "Maruke Obrecht-Grendahl")]),
    ("my social security number" + " " * 300 + "is 135792468", [("id_number", "135792468")]),
    ("Maruke" + " " * 300 + "Obrecht", [("person", "Maruke" + " " * 300 + "Obrecht")]),
])
def test_find(text, want):
    assert kinds(text) == want


def test_very_long_text():
    text = "word 12 " * 100_000 + "a@b.test"
    assert kinds(text) == [("email", "a@b.test")]


NAMES = Detector(["Anna", "Bo", "Li", "Maruke", "Tovin", "明"], ["Keller", "Wu", "Li", "Obrecht", "李"])


def rewritten(text, key="key"):
    out, at = [], 0
    for kind, lo, hi, parts in NAMES.mentions(text):
        out += [text[at:lo], replacement(kind, text[lo:hi], parts, lo, key, lambda e: 0)]
        at = hi
    return "".join(out) + text[at:]


def test_spellings_of_an_entity_agree():
    full, comma, short, loud, low = rewritten("Anna Keller|Keller, Anna|A. Keller|ANNA KELLER|anna keller").split("|")
    given, family = full.split()
    assert comma == f"{family}, {given}" and short == f"{given[0]}. {family}" and loud == full.upper() and low == full.lower()
    a, b, c = rewritten("anna@site.example|Anna@Site.example|anna (at) site.example").split("|")
    assert a == b and c == a.replace("@", " (at) ")
    a, b = rewritten("+44 (0)20 7946 0892|0044 20 7946 0892").split("|")
    assert "".join(filter(str.isdigit, a.replace("(0)", "")))[2:] == "".join(filter(str.isdigit, b))[4:] and a.startswith("+44 (0)") and b.startswith("0044 ")
    a, b = rewritten("12 Umber St.|12 umber street").split("|")
    assert a.lower().split()[:2] == b.split()[:2] and a.endswith(" St.") and b.endswith(" street")
    a, b = rewritten("666-98-4587|666 98 4587").split("|")
    assert a.replace("-", " ") == b


def test_no_part_stays():
    for text in ("Bo Wu", "Bo Li", "Anna Wu", "李明", "Li Bo", "A. Wu"):
        new = rewritten(text)
        assert not {w.lower().strip(".") for w in new.split()} & {w.lower().strip(".") for w in text.split()}, (text, new)
        assert new != text
    assert rewritten("+44 1632 960 109")[4:7] != "163"
    assert rewritten("anna.keller@home.example") != rewritten("anna.keller@home.example", "other")


def test_surrogates_keep_kind_gender_script_and_format():
    assert female(rewritten("Anna Keller").split()[0]) and not female(rewritten("Tovin Keller").split()[0])
    assert all("一" <= c <= "鿿" for c in rewritten("李明")) and len(rewritten("李明")) == 2
    s = rewritten("990022198506143677")
    assert len(s) == 18 and 1 <= int(s[10:12]) <= 12 and s[-1] == "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(s[:17])) % 11]
    assert valid_number(rewritten("DNI 12345678Z")[4:])
    s = rewritten("云溪路182号2单元")
    assert s[2] == "路" and s.endswith("单元") and s[:2] != "云溪"
    assert rewritten("64 rue Willet, 58329 Tarnwick The").split()[1] == "rue"
    s = rewritten("qq-74-99-47-b")
    assert [c.isdigit() for c in s] == [c.isdigit() for c in "qq-74-99-47-b"] and s == s.lower()
    for kind, text in (("phone", "01632 960231"), ("email", "a.b@c.example"), ("address", "45 E. Saffron Close, Apt 6C")):
        assert len(entity_of(kind, text)) == 1


def test_frames(spark):
    e = spark.createDataFrame([("person", "Maruke Obrecht"), ("person", "Grendahl, Tovin"), (None, "X Y"), ("city", "Tarnwick")], "entity_type string, entity_name string")
    rows = [("messages", 1, "🎉 Maruke Obrecht: a@b.test"), ("messages", 2, None), ("notes", 1, "a@b.test and a@b.test"), ("notes", 2, ""), ("notes", 3, "plain"), ("messages", 1, "🎉 Maruke Obrecht: a@b.test")]
    t = spark.createDataFrame(rows[:5], "tbl string, ingest_no bigint, content string").selectExpr("*", "'clash' AS kind")
    m = find_mentions(t, e)
    got = sorted((r["tbl"], r["ingest_no"], r["kind"], r["start_pos"]) for r in m.collect())
    assert got == [("messages", 1, "email", 19), ("messages", 1, "person", 3), ("notes", 1, "email", 1), ("notes", 1, "email", 14)]
    red = {(r["tbl"], r["ingest_no"]): r["content"] for r in redact(t, e).collect()}
    assert red == {("messages", 1): "🎉 [PERSON]: [EMAIL]", ("messages", 2): None, ("notes", 1): "[EMAIL] and [EMAIL]", ("notes", 2): "", ("notes", 3): "plain"}
    assert "Exchange" not in redact(t, e)._jdf.queryExecution().executedPlan().toString()
    new = {(r["tbl"], r["ingest_no"]): (r["content"], r["n_mentions"]) for r in replace_by_surrogates(t, e, "key").collect()}
    mail = new["notes", 1][0].split(" and ")
    assert mail[0] == mail[1] != "a@b.test" and new["messages", 1][0].endswith(": " + mail[0]) and new["messages", 2] == (None, 0) and new["notes", 3] == ("plain", 0)
    assert find_mentions(t.limit(0), e).count() == 0 and find_mentions(t, e.limit(0)).where("kind = 'person'").count() == 0
    assert replace_by_surrogates(t.limit(0), e, "key").count() == 0
    with pytest.raises(ValueError):
        replace_by_surrogates(t, e, "")


def test_salted_entities_by_join_or_broadcast(spark):
    e = spark.createDataFrame([("person", "Bo Wu"), ("person", "Li, Bo")], "entity_type string, entity_name string")
    rows = [("messages", i, f"{i % 7 + 1:03}-{i % 90 + 10}-{i + 1000} Bo Wu and Bo Li") for i in range(300)] + [("messages", 300, None), ("messages", 299, "Bo Wu")]
    t = spark.createDataFrame(rows, "tbl string, ingest_no bigint, content string")
    made = assign_surrogates(entities_in(t, e), "key")
    assert made.groupBy("kind", "surrogate").count().where("count > 1").count() == 0
    one = sorted(map(tuple, replace_by_surrogates(t, e, "key").collect()), key=repr)
    two = sorted(map(tuple, replace_by_surrogates(t, e, "key", max_salts=-1).collect()), key=repr)
    assert one == two and len(one) == len(rows)


def test_colliding_surrogates_are_made_again(spark):
    rows = [("phone", f"+44 1632960{i:03}") for i in range(300)] + [("id_number", f"{i}") for i in range(10)] + [("id_number", f"{i:02}") for i in range(60)] + [("family", "李"), ("given", "李\0明"), (None, "x"), ("phone", None)]
    found = spark.createDataFrame(rows + rows[:5], "kind string, entity string")
    made = assign_surrogates(found, "key").collect()
    assert len(made) == 372 and len({(r["kind"], r["surrogate"]) for r in made}) == 372
    assert not {(r["kind"], r["surrogate"]) for r in made} & set(rows)
    # ten numbers of one digit leave no free one of one digit: they grow
    assert max(r["salt"] for r in made) >= GROWING and surrogate("id_number", "1", "key", GROWING) != surrogate("id_number", "1", "key", 0)
