"""Text operators against brute force, exact round trips and hand-made cases."""

import base64
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import chunking, ocr, packing, pii, tokenizer, truncation

# Encoding --------------------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(tokenizer.FOLDER, tokenizer.VOCABULARY)), reason="no vocabulary")


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(os.path.join(tokenizer.FOLDER, tokenizer.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lists(texts):
    ids, begin = tokenizer.encoder().batch(texts)
    return [ids[a:z].tolist() for a, z in itertools.pairwise(begin)]


@needs_vocabulary
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60) | st.sampled_from(["it's 1234567 o'clock", "  \n\n x", "<|endoftext|>", "日本語 テスト", "a" * 700, "ﬁ—“x”", "👍🏽👍🏽"]), max_size=6))
def test_ids_like_the_public_library(public, texts):
    assert _lists(texts) == [public.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_round_trip_and_other_vocabulary():
    e = tokenizer.encoder(vocabulary="byte_bpe_multi_50k.tiktoken")
    for t in ("Olá, ção!", "\x00\x7f ", "x" * 5000, "mixed 汉字 and emoji 😀"):
        ids, _ = e.batch([t])
        assert b"".join(e.tokens[i] for i in ids).decode() == t


def test_perfect_hash_is_minimal_and_exact():
    keys = [bytes([a, b]) for a in range(64) for b in range(64)] + [b"", b"longer key"]
    h = tokenizer.PerfectHash(keys)
    assert sorted(h.slot.tolist()) == list(range(len(keys)))
    assert h.find(pa.array(keys, pa.large_binary())).tolist() == list(range(len(keys)))
    h.keys = pa.array([b"\xff" + k for k in keys], pa.large_binary())  # keys of the same prints, but other bytes
    assert set(h.find(pa.array(keys, pa.large_binary())).tolist()) == {-1}
    assert set(h.find(pa.array([b"nope", b"xyz", b"longer keys"], pa.large_binary())).tolist()) == {-1}


@needs_vocabulary
def test_encode_frames(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, "", "x"), (3, None, None), (3, None, None), (None, " a", "y")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokenizer.encode(df).collect()]
    assert got[1:4] == [(2, []), (3, []), (3, [])] and got[0][1] and got[4][0] is None
    assert [r.n_tokens for r in tokenizer.sizes(df).collect()] == [len(i) for _, i in got]
    assert tokenizer.encode(df.limit(0)).count() == 0


# Packing ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_uses_every_item_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65)
    used, boxes = np.zeros(65, np.int64), 0
    for pattern, repeats in packing.plan(counts, 64):
        assert sum(n * k for n, k in pattern) <= 64 and repeats > 0
        for n, k in pattern:
            used[n] += k * repeats
        boxes += repeats
    assert (used == counts).all()
    # Never worse than first fit of the sorted lengths by more than a tenth and one.
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, b in enumerate(bins) if b + n <= 64), None)
        if i is None:
            bins.append(n)
        else:
            bins[i] += n
    assert boxes <= len(bins) * 1.1 + 1


def test_nnls_finds_the_exact_repeats():
    columns = [((3, 1), (5, 2)), ((5, 1),), ((4, 3),)]
    target = np.zeros(14)
    target[[3, 5, 4]] = [10, 27, 6]
    assert np.allclose(packing.nnls(columns, target), [10, 7, 2], atol=0.1)


def test_second_lengths_are_spread_over_all_that_fit():
    counts = np.ones(1025, np.int64)
    counts[0] = 0
    pairs = [c for c in packing.combinations(counts, 1024, 10) if c[0] == (700, 1)]
    assert max(c[1][0] for c in pairs) == 324 and len(pairs) <= packing.KEPT


def test_pack_ranks_a_hot_length_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    df = spark.range(1000).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") < 700, 40).otherwise(F.col("id") % 37 + 3).cast("int").alias("n_tokens"))
    got = packing.pack(df, capacity=100).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()
    assert max(r.n for r in got) <= 100 and sum(r.k for r in got) == 1000 and {r.container for r in got} == set(range(len(got)))


def test_pack_frames(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([7, 7, 7, 20, 33, 50, 99]), "x") for i in range(3000)] + [(9001, 250, "x"), (9002, 0, None), (9003, None, None), (9004, 100, None), (None, 5, None), (7, 7, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, container string")
    got = packing.pack(df, capacity=100).collect()
    load: dict = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 100 and set(load) == set(range(max(load) + 1))
    total = sum(r[1] or 0 for r in rows)
    assert sum(load.values()) == total and len(load) <= total / 100 * 1.08 + 2
    assert sorted((r.part, r.start, r.n_tokens) for r in got if r.doc_id == 9001) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert len([r for r in got if r.doc_id in (9002, 9003)]) == 2 and len([r for r in got if r.doc_id == 7]) == 2
    assert len(got) == len(rows) + 2
    assert packing.pack(df.limit(0), capacity=100).count() == 0
    zeros = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens int"), capacity=100).collect()
    assert [r.container for r in zeros] == [0, 0]


# Cutting ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.\n,X é", max_size=900), st.integers(0, 60) | st.none(), st.integers(0, 80) | st.none())
def test_cuts_share_the_whole_overlap(text, size, overlap):
    parts = chunking.cut(text, size, overlap)
    limit = max(1, 500 if size is None else size)
    lap = min(50 if overlap is None else overlap, limit - 1)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all((z - a) // 4 <= limit for a, z in parts)
    for (a, z), (a2, z2) in itertools.pairwise(parts):
        assert (z - a2) // 4 == lap and a2 > a and z2 > z


def test_pieces_share_more_than_half_the_size(spark):
    chunk = spark.createDataFrame([("a", 1, 10, "The boiler heats water, and steam moves. " * 40)], "doc_id string, chunk_index int, request_id bigint, text string")
    request = spark.createDataFrame([(10, 64, 50)], "request_id bigint, chunk_size int, chunk_overlap int")
    got = sorted((r.piece, r.start_pos, len(r.text)) for r in chunking.pieces(chunk, request).collect())
    assert len(got) > 10 and all(n // 4 <= 64 for *_, n in got)
    assert {(a + n - a2) // 4 for (_, a, n), (_, a2, _) in itertools.pairwise(got)} == {50}


def test_cuts_where_the_topic_ends():
    first = "The boiler heats water and the water moves steam through the boiler pipe. " * 6
    second = "Parliament voted the budget while ministers debated taxes in parliament. " * 6
    (a, z), *_ = chunking.cut(first + second, size=(len(first) + 120) // 4, overlap=0)
    assert z == len(first)


def test_pieces_frames(spark):
    chunk = spark.createDataFrame(
        [("a", 1, 10, "w " * 400, "s"), ("a", 1, 10, "w " * 400, "s"), ("a", 2, 10, "short", "s"), ("b", 1, 11, "x" * 2100, "s"), ("b", 2, 99, "y" * 2004, None), ("b", 3, None, "z" * 1999, None), ("c", 1, 10, None, None), ("c", 2, 10, "", None)],
        "doc_id string, chunk_index int, request_id bigint, text string, size string",
    )
    request = spark.createDataFrame([(10, 50, 10, "x"), (10, 50, 10, "x"), (11, None, None, None), (None, 1, 1, None)], "request_id bigint, chunk_size int, chunk_overlap int, text string")
    got = chunking.pieces(chunk, request).collect()
    assert {(r.doc_id, r.chunk_index) for r in got} == {("a", 1), ("b", 1), ("b", 2)}
    a = sorted((r.piece, r.start_pos, r.text) for r in got if r.doc_id == "a")
    assert [p[0] for p in a] == list(range(len(a))) and all(len(p[2]) // 4 <= 50 for p in a)
    assert chunking.pieces(chunk.limit(0), request).count() == 0
    assert {(r.doc_id, r.chunk_index) for r in chunking.pieces(chunk, request.limit(0)).collect()} == {("b", 1), ("b", 2)}


# Private items ---------------------------------------------------------------------------------------------------------

ITEMS = [
    ("Contato: ana.b+x@mail.example, sem", "email", "ana.b+x@mail.example"), ("O cadastro 716.823.478-17 pertence", "id_number", "716.823.478-17"), ("Inscrito no CPF sob o nº 53236003571.", "id_number", "53236003571"), ("RG 69.353.101-8, conferido", "id_number", "69.353.101-8"),
    ("Social number 000-85-9661, checked", "id_number", "000-85-9661"), ("ID no. ZZ5854975.", "id_number", "ZZ5854975"), ("Tel.: 39-5550 6046.", "phone", "39-5550 6046"), ("Ligar para +55 (36) 9 5550 5665 em", "phone", "+55 (36) 9 5550 5665"), ("Call 555.555.0195 during", "phone", "555.555.0195"),
    ("fica na Rua Isidra Tolivera, 162, apto 4.", "address", "Rua Isidra Tolivera, 162, apto 4"), ("Residente na Rodovia do Alecrim, km 10.", "address", "Rodovia do Alecrim, km 10"), ("Deliver to 1462 Copperfield Court, Unit 23, against", "address", "1462 Copperfield Court, Unit 23"),
    ("A Sra. Belmira Lavradelo compareceu", "name", "Belmira Lavradelo"), ("assinado por GALBANTARES, Dortasia e juntado", "name", "GALBANTARES, Dortasia"), ("Segundo Quirino dos\nTampelvane, a obra", "name", "Quirino dos\nTampelvane"), ("Conforme declarou Ana Navetta Prado, o", "name", "Ana Navetta Prado"),
]
NOTHING = [
    "A Construtora Pedra Lume Ltda., CNPJ 32.616.376/0000-33, apresentou defesa.", "A nota fiscal 44908727524 foi conferida.", "Ver o processo 5304492-62.2019.0.00.8676, apenso ao volume 44.", "O perfil @acervo_digital divulgou o aviso.", "A rua principal segue interditada.", "A Serra do Campanil delimita a área.",
    "Invoice 35414478165 was reconciled.", "Stone Harbour Works Ltd. filed a reply.", "O item 49.45 do Anexo Único foi revisto.", "O lote foi cotado em R$ 4.304,00.", "", "METODOLOGIA\nAssim, o fiscal", "Quadro 5\n53   21   96",
]


@pytest.mark.parametrize(("text", "kind", "item"), ITEMS)
def test_items(text, kind, item):
    assert [(k, text[a:z]) for k, a, z, _ in pii.find(text)] == [(kind, item)]
    assert pii.mask(text) == text.replace(item, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", NOTHING)
def test_no_items(text):
    assert pii.find(text) == [] and pii.mask(text) == text


# Sentences written for this test, with all names in them.
HAND = [
    ("Prezada Maria Souza, segue o contrato.", ["Maria Souza"]), ("Obrigado, Carlos Lima", ["Carlos Lima"]), ("Best regards, Anna Weber", ["Anna Weber"]), ("my name is John Smith and I live here", ["John Smith"]), ("Contact: Maria Souza (11) 97777-1234", ["Maria Souza"]),
    ("Dear Mr. Paul Brown, thank you.", ["Paul Brown"]), ("Meu nome é Joana Prado.", ["Joana Prado"]), ("O laudo foi elaborado por Tiago Nunes de Sá em maio.", ["Tiago Nunes de Sá"]), ("Atenciosamente,\nRita Campos", ["Rita Campos"]), ("Paciente: Helena Dias, 43 anos", ["Helena Dias"]),
    ("According to Emily Carter, the pump failed.", ["Emily Carter"]), ("The report was written by Omar Haddad.", ["Omar Haddad"]), ("Kind regards\nLaura Stein", ["Laura Stein"]), ("a Sra. Inês Moura e o Dr. Caio Brito assinaram", ["Inês Moura", "Caio Brito"]), ("Recebido por marcos vieira, na portaria.", ["marcos vieira"]),
    ("Marta Rocha declarou que não viu nada.", ["Marta Rocha"]), ("Peter Novak signed the form.", ["Peter Novak"]), ("Remetente: Lia Azevedo", ["Lia Azevedo"]), ("A Prefeitura de Campo Grande informou o prazo.", []), ("The Grand Ridge signed nothing.", []), ("Universidade Federal de Minas confirmou a data.", []),
    ("Ligue para Sofia Telles (21) 98888-0000.", ["Sofia Telles"]), ("Aos cuidados de Bruno Farias", ["Bruno Farias"]), ("o documento foi recebido por marcos vieira, na portaria.", ["marcos vieira"]), ("Yesterday I met Clara Jensen in Oslo.", ["Clara Jensen"]), ("O gol de Pedro Leal decidiu a partida.", ["Pedro Leal"]),
]


def test_names_in_ordinary_letters():
    """General cues find most names (21 of 24); without any cue (the last two) a name stays, as a place would."""
    wanted = found = right = 0
    for text, names in HAND:
        got = [text[a:z] for k, a, z, _ in pii.find(text) if k == "name"]
        wanted, found, right = wanted + len(names), found + len(got), right + len(set(got) & set(names))
    assert right == found and right / wanted >= 0.87


def test_a_wrong_check_digit_needs_context():
    assert pii.find("o valor 111.444.777-34 confere") == [] and pii.mask("CPF 111.444.777-34") == "CPF [ID_NUMBER]" and pii.mask("o 529.982.247-25 confere") == "o [ID_NUMBER] confere"


def test_many_items_in_one_text():
    text = "Contato: a.b@mail.example; " * 20_000
    assert len(pii.find(text)) == 20_000


def test_checksums():
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.mod11("529.982.247-25", 11) and not pii.mod11("529.982.247-26", 11)


def test_item_frames(spark):
    text = "Oi. A Sra. Belmira Lavradelo compareceu, tel. (72) 95550-3297."
    rows = [("pages", "d", 1, text, "x"), ("pages", "d", 1, text, "x"), ("chunks", "d", 1, text, None), ("pages", "e", 1, None, None), ("pages", "e", 2, "", None), ("pages", None, None, "a@b.example", None), ("pages", "l", 1, "palavra " * 200_000 + "x@y.example", None)]
    df = spark.createDataFrame(rows, "src string, doc_id string, item_no int, text string, kind string")
    got = sorted((r.src, r.doc_id or "", r.kind, r.start_pos) for r in pii.items(df).collect())
    one = [("name", text.index("Belmira") + 1), ("phone", text.index("(72)") + 1)]
    assert got == sorted([(s, "d", *c) for s in ("pages", "chunks") for c in one] + [("pages", "", "email", 1), ("pages", "l", "email", 1_600_001)])
    assert [r.t for r in df.where("doc_id = 'e'").select(pii.masked(F.col("text")).alias("t")).collect()] == [None, ""]
    assert pii.items(df.limit(0)).count() == 0


# Scanned pages ---------------------------------------------------------------------------------------------------------


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abrnm", min_size=1, max_size=6), max_size=25), st.text(alphabet="abrnm", min_size=1, max_size=6))
def test_automaton_finds_all_within_reach(words, query):
    got = {w for w, _, _ in ocr.Trie(dict.fromkeys(words, 1)).near(query)}
    assert {w for w in words if 0 < _distance(w, query) <= 1} <= got - {query} | set()
    for w in got - {query}:
        assert _distance(w, query) <= 2  # two for one and one for two reach a little further


def test_known_misreadings():
    trie = ocr.Trie({"contrato": 500, "fornecedora": 500, "norma": 500, "cláusula": 500, "rua": 40, "anexo": 500})
    fix = lambda w, n=1: max(((known, uses, c) for c, uses, known in ocr.corrections(w, n, trie)), default=(0, 0, None))[2]
    assert [fix(w) for w in ("contiato", "fomecedora", "riorma", "dáusula", "con†rato", "arexo", "ariexo")] == ["contrato", "fornecedora", "norma", "cláusula", "contrato", None, "anexo"]
    assert fix("contiato", 100) is None  # too frequent to be a misreading


def _scan(spark):
    body = "a equipe revisou o contrato e a garantia do painel pré-moldado no anexo da obra"
    rows = []
    for doc in ("a", "b", "c", "d"):
        for page in range(1, 7):
            lines = [f"Relatório interno {doc * 2}7", *[body] * 8, "A equipe revi-", "sou o contrato do painel pré-", "moldado e a garan-", "Cópia única" if page == 3 else "tia.", *(["tia."] if page == 3 else []), "o contiato, a obra" if page == 2 else "o contrato, a obra", "", f"Página {page} de 6" if doc != "b" else f"{page + 3}"]
            rows.append((doc, page, "\n".join(lines), "x"))
    rows += [rows[0], ("n", 1, None, "x"), ("n", 2, "", "x"), ("n", None, "so\nlines", "x"), (None, 1, "x", "x")]
    return spark.createDataFrame(rows, "doc_id string, page int, raw_text string, kind string")


def test_lines_to_repair(spark):
    got = {}
    rows = ocr.lines_to_repair(_scan(spark)).collect()
    for r in rows:
        got.setdefault((r.doc_id, r.page), []).append((r.line_no, r.kind))
    assert len(rows) == len(set(rows))
    assert sorted(got["a", 1]) == [(1, "furniture"), (10, "hyphen"), (12, "hyphen"), (16, "furniture")]
    assert sorted(got["b", 2]) == [(1, "furniture"), (10, "hyphen"), (12, "hyphen"), (14, "misread"), (16, "furniture")]
    assert (12, "hyphen") in got["a", 3] and ("n", 1) not in got
    assert ocr.lines_to_repair(_scan(spark).limit(0)).count() == 0


@pytest.mark.parametrize("held", [1, 10])
def test_what_tasks_do_not_hold_is_fetched(spark, monkeypatch, held):
    every = {tuple(r) for r in ocr.lines_to_repair(_scan(spark)).collect()}
    monkeypatch.setattr(ocr, "SAFE_WORDS", held)
    monkeypatch.setattr(ocr, "TEMPLATES", 1)
    assert {tuple(r) for r in ocr.lines_to_repair(_scan(spark)).collect()} == every and len(every) > 50


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abrnm", min_size=3, max_size=12), st.integers(0, 12), st.sampled_from(["", "a", "rn", "m"]), st.integers(0, 2))
def test_words_one_misreading_apart_share_a_key(word, at, put, gone):
    gone = min(gone, 2 if len(put) == 1 else 1)
    other = word[:at] + put + word[at + gone :]

    def keys(w):
        n = len(w)
        return {(k, e, w[:k] if e else w[-k:]) for k, low, high in ((1, 0, 6), (2, 6, 9), (4, 9, 99)) for e in (0, 1) if low <= n <= high}

    assert len(other) < 3 or abs(len(other) - len(word)) > 1 or keys(word) & keys(other)


def test_paragraphs(spark):
    text = {(r.doc_id, r.page, r.paragraph): r.text for r in ocr.paragraphs(_scan(spark)).collect()}
    p = text["a", 2, 1]
    assert p.endswith("A equipe revisou o contrato do painel pré-moldado e a garantia. o contrato, a obra") and "Página" not in p and "Relatório" not in p
    assert ("n", 1, 1) not in text


def test_the_words_beside_a_misread_word_choose(spark):
    plain = "a diretoria administrativa aprovou a multa e o quadro administrativo seguiu\nno relatório da obra " * 6
    rows = [("a", k, plain) for k in range(1, 12)] + [("b", 1, "a diretoria administrativ3 aprovou"), ("b", 2, "o quadro administrativ3 seguiu")]
    got = {(r.doc_id, r.page): r.text for r in ocr.paragraphs(spark.createDataFrame(rows, "doc_id string, page int, raw_text string")).where("doc_id = 'b'").collect()}
    assert got == {("b", 1): "a diretoria administrativa aprovou", ("b", 2): "o quadro administrativo seguiu"}


def test_a_word_broken_over_the_pages_end_keeps_its_mark():
    assert ocr.reflow(["durante o se-"], set(), {1: "se"}, {}) == ["durante o se-"] and ocr.reflow(["o se-", "gundo"], set(), {1: "se\x00gundo"}, {}) == ["o segundo"]


def test_page_number_beside_a_running_header(spark):
    body = "a equipe revisou o contrato e a garantia do painel no anexo da obra"
    foot = lambda n: f"Página {n} de 12   Processo administrativo 628 | Volume II"
    rows = [(doc, n, "\n".join([*[body] * 9, "", foot(n) if n % 2 else "Conselho geral de revisão das obras do porto novo da cidade"])) for doc in "ab" for n in range(1, 7)]
    got = {(r.doc_id, r.page): r.line_no for r in ocr.lines_to_repair(spark.createDataFrame(rows, "doc_id string, page int, raw_text string")).where("kind = 'furniture' and line_no = 11").collect()}
    assert len(foot(1).split()) > 9 and set(got) == {(doc, n) for doc in "ab" for n in range(1, 7)}
    assert ocr.furniture_parts("Proc. 2 vol.   p. 3") and not ocr.furniture_parts("Página 2   o contrato, a obra") and not ocr.furniture_parts("Página 2   a obra terminou.")


# Cut texts -------------------------------------------------------------------------------------------------------------


def _reviews():
    starts = ["The zipper is", "My sister says the motor is", "Honestly, the handle turned out"]
    ends = ["easy to clean even in winter.", "very handy under daily use.", "far too noisy after a week.", "worth the price."]
    full = [f"{s} {e}" for s in starts for e in ends]
    rows, k = [], 0

    def put(text, source):
        nonlocal k
        k += 1
        rows.append((k, text, source, "x"))
        return k

    for i in range(60):
        put(" ".join(full[(i + j) % 12] for j in range(4)), "web")
    limit = [put((" ".join(full[(i * 5 + j) % 12] for j in range(9)))[:100], "kiosk") for i in range(12)]
    cut = [put(f"{full[0]} The zipper is ea", "web"), put(f"{full[1]} My sister says the", "web"), put("The motor is very handy under dai...", "web"), put(f"{full[2]} The zip�", "web")]
    fine = [put(f"{full[3]} would buy again", "web"), put("My sister says the motor is worth the price", "web"), put("Adorei", "web"), put(None, "web"), put("", None), put("  ", "web"), put(f"{full[4]} 👍", "web"), put(f"{full[5]} recommended...", "web")]
    return rows, cut, fine, limit


def test_cut_texts(spark):
    rows, cut, fine, limit = _reviews()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cut string")
    got = {r.doc_id: r for r in truncation.judge(df).collect()}
    assert len(got) == len(rows)
    assert [d for d in cut if not got[d].cut] == [] and [(d, got[d].why) for d in fine if got[d].cut] == []
    text = {r[0]: r[1] for r in rows}
    assert all(got[d].cut for d in limit if not text[d].rstrip().endswith("."))
    share = {r.source: (r.n_texts, r.n_cut) for r in truncation.shares(truncation.judge(df)).collect()}
    assert share["kiosk"][0] == 12 and share[""] == (1, 0)
    assert truncation.judge(df.limit(0)).count() == 0


def test_long_text_is_judged_by_its_end(spark):
    rows, *_ = _reviews()
    long = "The zipper is worth the price. " * 60_000
    df = spark.createDataFrame([*rows, (900, long, "web", "x"), (901, long + "The zipper is wor", "web", "x")], "doc_id bigint, text string, source string, cut string")
    got = {r.doc_id: r.cut for r in truncation.judge(df).where("doc_id >= 900").collect()}
    assert got == {900: False, 901: True}
