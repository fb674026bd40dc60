import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from velatura.config import LoopSettings, Settings
from velatura.functions import patterns, text
from velatura.operators import extractor, goldlabels, knowledge, lattice, ngrams, scoring, spans, tags, views
from velatura.plans import catalogue, pipeline
from velatura.sources import readers, sinks
from velatura.streaming import loops


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


# --- text and patterns ---


@pytest.mark.parametrize(
    "raw, clean",
    [("a\r\nb\rc", "a\nb\nc"), ("a  \n\t b", "a\nb"), ("a\n\n\n\n\nb", "a\n\nb"), ("  [x]  ", "[x]"), (None, ""), ("", "")],
)
def test_clean_record(spark, raw, clean):
    assert one(spark, raw, text.clean_record) == clean


def test_comparison_key_and_subject(spark):
    assert one(spark, "  Olá, MUNDO -  março!", text.comparison_key) == "olá mundo março"
    assert one(spark, "Paciente - p1", text.subject_key) == "P1"
    assert one(spark, None, text.comparison_key) is None


def test_tags_for_model_and_pretty(spark):
    assert one(spark, "x ⦃ CPF 1 ⦄", lambda c: text.to_model_tags(c, "⦃", "⦄")) == "x [ CPF 1 ]"
    assert one(spark, "x ⦃  CPF   1 ⦄", lambda c: text.pretty_tags(c, "⦃", "⦄")) == "x [CPF 1]"


def test_leaked_tags(spark):
    row = spark.createDataFrame([(["PERSON 3", "Maria", None, "EMAIL 20"], "[ PERSON 3 ] EMAIL 20"), (None, "x")], "t array<string>, c string")
    got = [r.r for r in row.select(text.drop_leaked_tags(F.col("t"), F.col("c")).alias("r")).collect()]
    assert got == [["Maria", "EMAIL 20"], []]


def test_valid_term(spark):
    rows = spark.createDataFrame([(x,) for x in ("a", "ab", "123", "12345", "x⦃y", " a ", None)], "t string")
    assert [r.r for r in rows.select(text.valid_term(F.col("t"), "⦃", "⦄").alias("r")).collect()] == [False, True, False, True, False, False, False]


def test_patterns_and_places(spark):
    t = "é 123.456.789-00, 31/12/24 e 5 de março; (82) 99999-1234; 82 99999-1234 a@b.co"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, t string")
    rows = patterns.scan(df, "id", "t").collect()
    assert {(r.padrao, r.termo) for r in rows} == {("CPF", "123.456.789-00"), ("DATA", "31/12/24"), ("DATA_EXTENSO", "5 de março"), ("TEL", "82 99999-1234"), ("EMAIL", "a@b.co")}
    assert all(t[r.ini : r.fim] == r.termo for r in rows)
    zero = patterns.pattern_counts(df.where("id = 3"), "id", "t").collect()
    assert len(zero) == 6 and all(r.total == 0 for r in zero)


def test_mask_characters(spark):
    df = spark.createDataFrame([("⦃ *",), (None,)], "t string")
    assert pipeline.absent_characters(df, "t") == ["⦄", "⟦"]
    with pytest.raises(ValueError):
        pipeline.absent_characters(spark.createDataFrame([("".join(text.MASK_CANDIDATES),)], "t string"), "t")


# --- spans and masks ---


def _know(spark, *rows):
    return spark.createDataFrame([(1, k, t, i + 1) for i, (k, t) in enumerate(rows)], pipeline.KNOWLEDGE)


def _mask(spark, t, *rows):
    rec = spark.createDataFrame([(0, t)], "rec_idx long, texto string")
    return spans.masks(rec, _know(spark, *rows), ("#", "?")).first().mascara


@pytest.mark.parametrize(
    "t, terms, want",
    [
        ("Anamnese de Ana.", [("nome", "Ana")], "Anamnese de ###."),
        ("MARIA e maria_x", [("nome", "Maria")], "##### e #####_x"),
        ("São Paulo, Paulo", [("endereco", "São Paulo"), ("nome", "Paulo")], "#########, #####"),
        ("Tem 39 anos, 39 C", [("info", "39 anos")], "Tem ## anos, 39 C"),
        ("Rosa Rosa Lima", [("unknown", "Rosa Lima"), ("nome", "Rosa")], "#### #### Lima"),
        ("Rosa Lima", [("unknown", "Rosa Lima")], "?????????"),
        ("em 31/12/24 só", [], "em ######## só"),
        ("àAna Ana à", [("nome", "Ana")], "àAna ### à"),
    ],
)
def test_masks(spark, t, terms, want):
    assert _mask(spark, t, *terms) == want


def _brute_spans(t, terms):
    low, out = t.lower(), []
    for term in terms:
        at = low.find(term.lower())
        while at >= 0:
            end = at + len(term)
            if not (at and t[at - 1].isalnum()) and not (end < len(t) and t[end].isalnum()):
                out.append((at, end, term))
            at = low.find(term.lower(), at + 1)
    return sorted(out)


def test_dictionary_spans_against_brute_force(spark):
    rng = random.Random(3)
    words = ["ana", "Ana", "de", "r.", "13/01", "x-y", "São", "paulo", "_", "é", "12", "a"]
    texts = [rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    terms = sorted({" ".join(rng.choice(words[:8]) for _ in range(k)) for k in (1, 2, 3, 4) for _ in range(12)})
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "rec_idx long, texto string")
    got = spans.dictionary_spans(df, spark.createDataFrame([(t,) for t in terms] + [("",), (None,)], "termo string")).collect()
    for i, t in enumerate(texts):
        assert sorted((r.ini, r.fim, r.termo) for r in got if r.rec_idx == i) == _brute_spans(t, terms)


def test_mask_keeps_length(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("Ana Rosa 1/2.é😀\n") for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_idx long, texto string")
    for r in spans.masks(df, _know(spark, ("nome", "Ana"), ("unknown", "Rosa")), ("#", "?")).collect():
        assert len(r.mascara) == len(r.texto) and all(a == b or b in "#?" for a, b in zip(r.texto, r.mascara))


# --- knowledge and tags ---


def test_register_gives_ids_in_order_and_keeps_terms_unique(spark):
    known = _know(spark, ("nome", "Ana"), ("revisao", "Rosa"))
    new = spark.createDataFrame([(1, "nome", "Bia", 5, 0, 0), (1, "nome", "Caio", 2, 0, 0), (1, "endereco", "Ana", 1, 0, 0), (1, "nome", " Rosa ", 9, 0, 0), (1, "info", "", 1, 0, 0), (1, "nome", None, 1, 0, 0), (1, "nome", "Bia", 7, 0, 0)], "sessao_id long, tipo string, texto_original string, rec long, passo int, pos int")
    got = {(r.tipo, r.texto_original): r.id_local_sessao for r in knowledge.register(known, new, ["rec", "passo", "pos"]).collect()}
    assert got == {("nome", "Ana"): 1, ("nome", "Caio"): 2, ("nome", "Bia"): 3, ("nome", "Rosa"): 4}


def test_sequential_ids_at_any_parallelism(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "g int, o int")
    for parts in (1, 7):
        rows = knowledge.sequential_ids(df.repartition(5), ["g"], ["o"], "k", parts).collect()
        assert sorted((r.g, r.o, r.k) for r in rows) == sorted((i % 3, i, i // 3 + 1) for i in range(500))


def test_upsert_retype_load_resume(spark):
    a, b = _know(spark, ("nome", "Ana"), ("nome", "Bia")), spark.createDataFrame([(1, "nome", "Ana", 9), (1, "info", "x", 1)], pipeline.KNOWLEDGE)
    assert sorted((r.texto_original, r.id_local_sessao) for r in knowledge.upsert(a, b).collect()) == [("Ana", 9), ("Bia", 2), ("x", 1)]
    assert knowledge.upsert(a, b.limit(0)).count() == 2
    assert knowledge.retype(a, 1, "nome", "velho", ["Ana"]).where("tipo = 'velho'").count() == 1
    assert knowledge.load(a, 1).count() == 2
    log = spark.createDataFrame([(1, "ngram", None, 30), (1, "ngram", None, 28), (2, "linha_a_linha", 4, None)], "sessao_id long, fase_atual string, evolucao_index int, tamanho_ngram int")
    assert {r.sessao_id: (r.ultima_linha, r.proximo_n) for r in knowledge.resume_points(log).collect()} == {1: (-1, 28), 2: (4, 102)}


def test_tag_and_restore(spark):
    rec = spark.createDataFrame([(0, "Ana Lima ligou (82) ou 82 99999-1234 em 31/12/24; ANA foi."), (1, "nada"), (2, "")], "rec_idx long, texto string")
    tagged, known = tags.anonymise(rec, _know(spark, ("nome", "Ana Lima"), ("nome", "Ana")), 1, "⦃", "⦄")
    rows = {r.rec_idx: r.texto for r in tagged.collect()}
    assert rows[0] == "⦃ PERSON 1 ⦄ ligou (82) ou ⦃ PHONE 1 ⦄ em ⦃ DATE 1 ⦄; ⦃ PERSON 3 ⦄ foi." and rows[1] == "nada" and rows[2] == ""
    back = {r.rec_idx: r.texto for r in tags.restore(tagged, known, "⦃", "⦄").collect()}
    assert back == {r.rec_idx: r.texto for r in rec.collect()}


def test_restore_takes_suffix_and_leaves_unknown_tags(spark):
    known = _know(spark, ("info", "39 anos"))
    df = spark.createDataFrame([(0, "⦃ INFO 1 ⦄ anos, ⦃ INFO 7 ⦄, ⦃ X ⦄")], "rec_idx long, texto string")
    assert tags.restore(df, known, "⦃", "⦄").first().texto == "39 anos, ⦃ INFO 7 ⦄, ⦃ X ⦄"


def test_union_and_intersection(spark):
    k = spark.createDataFrame([(1, "nome", "b", 1), (1, "nome", "a", 2), (2, "nome", "a", 1), (2, "unknown", "u", 1)], pipeline.KNOWLEDGE)
    assert [(r.texto_original, r.id) for r in knowledge.union_sessions(k, [1, 2]).where("tipo = 'nome'").orderBy("id").collect()] == [("b", 1), ("a", 2)]
    assert {(r.tipo, r.texto_original) for r in knowledge.intersect_sessions(k, [1, 2]).collect()} == {("nome", "a"), ("unknown", "u")}
    assert knowledge.union_sessions(k.limit(0), [1]).count() == 0


def test_safe_fragments(spark):
    df = spark.createDataFrame([("Paciente Ana Maria está muito bem hoje. ANA saiu\ncurto\nnasceu em 31/12/24 no hospital geral", ["Ana Maria", "ana"])], "t string, k array<string>")
    assert df.select(knowledge.safe_fragments(F.col("t"), F.col("k")).alias("r")).first().r == ["está muito bem hoje"]


# --- n-grams ---


def test_ngram_candidates(spark):
    rows = [(i, f"P{i % 6}", "o paciente nega dor no peito") for i in range(7)] + [(9, "P1", None), (10, "", "o paciente nega dor")]
    frags = ngrams.corpus(spark.createDataFrame(rows, "r long, p string, t string"), "p", "t", "r")
    got = {r.frase: (r.total, r.pacientes) for r in ngrams.candidates(frags, 5, 6).collect()}
    assert got == {"o paciente nega dor no": (7, 6), "paciente nega dor no peito": (7, 6)}
    assert ngrams.largest_viable(frags, 2, 20, 6) == 6
    assert ngrams.mine(frags, 10, 3, 6) == [(6, "o paciente nega dor no peito")]
    assert ngrams.candidates(frags.limit(0), 3).count() == 0


def test_removal_cuts_fragments(spark):
    frags = ngrams.corpus(spark.createDataFrame([(1, "A", "um dois três quatro cinco")], "r long, p string, t string"), "p", "t", "r")
    assert sorted(r.tokens for r in ngrams.without_phrases(frags, ["três"]).collect()) == [["quatro", "cinco"], ["um", "dois"]]


# --- gold labels ---

LAB = "array<struct<word:string,category:string,subcategory:string,first_position:int,last_position:int>>"


@pytest.mark.parametrize(
    "t, labels, clean, words, bad",
    [
        ("Paciente <PATIENT>Maria</PATIENT/> atendida.", [("Maria", "PATIENT", 18, 23)], "Paciente Maria atendida.", [("Maria", 9)], False),
        ("Dr. <DOCTOR>Silva</DOCTOR/> atende <PATIENT>Ana</PATIENT/>.", [("Ana", "PATIENT", 44, 47), ("Silva", "DOCTOR", 12, 17)], "Dr. Silva atende Ana.", [("Silva", 4), ("Ana", 17)], False),
        ("Hospital <HOSPITAL> Jardim</HOSPITAL/> Municipal.", [(" Jardim", "HOSPITAL", 19, 26)], "Hospital  Jardim Municipal.", [("Jardim", 10)], False),
        ("Rua <STREET>Centro </STREET/>número 10.", [("Centro ", "STREET", 12, 19)], "Rua Centronúmero 10.", [("Centro", 4)], False),
        ("Paciente Maria</PATIENT> atendida.", [("Maria", "PATIENT", 9, 14)], None, None, True),
        ("Paciente <PATIENT>Maria atendida.", [("Maria", "PATIENT", 18, 23)], None, None, True),
        ("A <PATIENT>Maria</PATIENT/> de <EXTRA>info</EXTRA/>.", [("Maria", "PATIENT", 11, 16)], None, None, True),
        ("sem rótulo", [], "sem rótulo", [], False),
        ("sem rótulo", None, "sem rótulo", [], False),
    ],
)
def test_clean_inline(spark, t, labels, clean, words, bad):
    rows = [(1, t, None if labels is None else [(w, "c", s, a, b) for w, s, a, b in labels])]
    r = goldlabels.clean_inline(spark.createDataFrame(rows, f"id long, text string, labels {LAB}")).first()
    assert r.com_erro == bad
    if not bad:
        assert r.texto_limpo == clean and [(x.word, x.first_position) for x in r.rotulos] == words
        assert all(clean[x.first_position : x.last_position] == x.word for x in r.rotulos)


def test_gold_records_number_on(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "b", None), (2, "<x>", None)], f"id long, text string, labels {LAB}")
    rows = goldlabels.gold_records(goldlabels.clean_inline(df)).orderBy("prontuario").collect()
    assert [(r.prontuario, r.descricao) for r in rows] == [(875, "b"), (876, "a")]


# --- scores ---


def _gold(spark, t, mask, *labels):
    return spark.createDataFrame([(1, t, [(t[a:b], "c", s, a, b) for s, a, b in labels], mask)], f"id long, text string, labels {LAB}, mask string")


def _score(df):
    v = scoring.verdicts(df, "id", "labels", "mask", ("#", "?"))
    return scoring.totals(v, scoring.residual_runs(df, "id", "text", "labels", "mask", ("#", "?"))).first()


def test_scores(spark):
    t = "Paciente Maria Silva mora em Maceió."
    full = "Paciente ########### mora em ######."
    r = _score(_gold(spark, t, full, ("PATIENT", 9, 20), ("CITY", 29, 35)))
    assert (r.tp, r.fn, r.fp, r.recall, r.precision, r.f2) == (2, 0, 0, 1.0, 1.0, 1.0)
    r = _score(_gold(spark, t, t, ("PATIENT", 9, 20)))
    assert (r.tp, r.fn, r.recall, r.precision) == (0, 1, 0.0, 0.0)
    r = _score(_gold(spark, t, "####iente ??????????? mora ##Maceió.", ("PATIENT", 9, 20)))
    assert (r.tp, r.tp_unknown, r.fp) == (0, 1, 1)
    half = _gold(spark, "abcde xxxx", "##cde xxxx", ("AGE", 0, 5))
    assert _score(half).fn == 1
    assert _score(_gold(spark, "abcde xxxx", "###de xxxx", ("AGE", 0, 5))).tp == 1
    assert _score(_gold(spark, "ab", "##", ("AGE", 0, 9))).fn == 1
    assert _score(_gold(spark, "ab", "##", ("AGE", 1, 1))).rotulos == 1
    assert _score(_gold(spark, "ab", "ab").limit(0)).f1 == 0.0


def test_ground_truth_and_buffer(spark):
    df = _gold(spark, "Ana em Rio", "x", ("PATIENT", 0, 3), ("CITY", 7, 99))
    assert df.select(scoring.ground_truth(F.col("text"), F.col("labels"), "*").alias("r")).first().r == "*** em ***"
    assert df.select(scoring.ground_truth(F.col("text"), F.col("labels"), "*", ["CITY"]).alias("r")).first().r == "Ana em ***"
    recs = spark.createDataFrame([(1, 3), (2, 2), (3, 4)], "id long, n int")
    assert {r.id: r.mascara for r in scoring.slice_buffer(recs, "abcde", "id", "n").collect()} == {1: "abc", 2: "de"}
    assert scoring.by_category(scoring.verdicts(df, "id", "labels", "mask", ("#", "?"))).count() == 2


# --- lattice ---


def test_next_level_needs_every_parent(spark):
    h = [([1], 0.5, False), ([2], 0.4, False), ([3], 0.3, False), ([1, 3], 0.6, False), ([2, 3], 0.5, False)]
    make = lambda rows: spark.createDataFrame(rows, "combo array<int>, f2 double, podado boolean")
    assert lattice.next_level(make(h), 3).count() == 0
    assert [r.combo for r in lattice.next_level(make([*h, ([1, 2], 0.6, False)]), 3).collect()] == [[1, 2, 3]]
    assert lattice.next_level(make([*h, ([1, 2], 0.6, True)]), 3).count() == 0
    assert sorted(r.combo for r in lattice.next_level(make(h), 2).collect()) == [[1, 2], [1, 3], [2, 3]]
    d = spark.createDataFrame([([1], 0.0, None), ([1, 2], 0.5, 0.5), ([1, 3], 0.6, 0.5)], "combo array<int>, f2 double, melhor_pai double")
    assert [r.podado for r in lattice.decide(d).collect()] == [False, True, False]


def test_search(spark):
    t = "Ana e Bia no Rio"
    rec = spark.createDataFrame([(1, t, [("Ana", "c", "PATIENT", 0, 3), ("Bia", "c", "PATIENT", 6, 9)])], f"rec_idx long, texto string, labels {LAB}")
    k = spark.createDataFrame([(1, "nome", "Ana", 1), (2, "nome", "Bia", 1), (3, "nome", "Rio", 1)], "sessao_id int, tipo string, texto_original string, id_local_sessao int")
    got = {tuple(r.combo): (round(r.f2, 3), r.podado) for r in lattice.search(rec, k, [1, 2, 3]).collect()}
    assert got[(1, 2)] == (1.0, False) and got[(1, 3)][1] and got[(3,)] == (0.0, False) and (1, 2, 3) not in got
    both = {tuple(r.combo): r.f2 for r in lattice.search(rec, k, [1, 2], "interseccao").collect()}
    assert both[(1, 2)] == 0.0
    assert lattice.parse_ids("3, 1 1") == [1, 3] and lattice.subsets(spark, [1, 2, 3]).count() == 7


# --- loops ---


def _feed(t, chunk=4, **kw):
    d = loops.LoopDetector(LoopSettings(**kw))
    for k in range(0, len(t), chunk):
        if hit := d.feed(t[k : k + chunk]):
            return hit, d.start
    return None, None


def test_detectors():
    assert _feed("A" * 400) == ("janela_exata", 0)
    lines = [f"linha número {i} com texto próprio {i * 7}" for i in range(20)]
    assert _feed("\n".join(lines) + "\n", active=frozenset({1, 3, 4}))[0] != "bloco_linhas"
    block = "primeira linha longa\nsegunda linha longa\nterceira linha longa\nquarta linha longa\n"
    hit, at = _feed("intro sem nada aqui\n" + block * 3, active=frozenset({4}))
    assert hit == "bloco_linhas"
    assert at == len("intro sem nada aqui\n" + block) + len(block) - len("quarta linha longa\n")
    assert _feed("intro sem nada aqui\n" + block * 3, active=frozenset({4}), block_offset="documented")[1] == len("intro sem nada aqui\n" + block)
    assert _feed("intro\n" + block * 2 + block[:40], active=frozenset({4})) == (None, None)
    words = " ".join(["um dois três quatro"] * 200)
    assert _feed(words, active=frozenset({2}))[0] == "rep_n"
    same = "".join(f"O item é igual ao outro item {'a' * (i % 2)}\n" for i in range(30))
    assert _feed(same, active=frozenset({3}))[0] == "cosine_sim"


def test_detector_state_survives():
    t = "x y z\n" * 10 + "bloco um aqui mesmo\nbloco dois aqui mesmo\n" * 6
    for cut in (3, 50, 120):
        a = loops.LoopDetector(LoopSettings(active=frozenset({4})))
        hits = [a.feed(t[:cut])]
        b = loops.LoopDetector(LoopSettings(active=frozenset({4})))
        b.load(a.dump())
        c = loops.LoopDetector(LoopSettings(active=frozenset({4})))
        c.feed(t[:cut])
        assert (hits[0] or b.feed(t[cut:])) == (hits[0] or c.feed(t[cut:])) and b.start == c.start


def test_batch_and_stream_agree(spark, tmp_path):
    texts = {1: "A" * 500, 2: "normal e curto", 3: "bloco um aqui mesmo\nbloco dois aqui mesmo\n" * 6, 4: ""}
    df = spark.createDataFrame(list(texts.items()) + [(5, None)], "id long, t string")
    batch = {r.id: (r.detector, r.inicio) for r in loops.detect_texts(df, "id", "t", chunk=10).collect()}
    assert batch[1][0] == "janela_exata" and batch[2] == (None, None) and 5 not in batch
    rows = [(i, k // 10, t[k : k + 10]) for i, t in texts.items() for k in range(0, len(t), 10)]
    rows = rows[::-1]  # out of order
    chunks = spark.createDataFrame(rows, "id long, q long, c string")
    assert {r.id: (r.detector, r.inicio) for r in loops.detect_chunks(chunks, "id", "q", "c").collect()} == {k: v for k, v in batch.items() if k != 4}
    chunks.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = loops.detect_stream(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "id", "q", "c")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: (r.detector, r.inicio) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: v for k, v in batch.items() if v[0]}


def test_compared(spark):
    df = spark.createDataFrame([("a", 5, "b", 7), ("a", 9, "b", 7), ("a", 7, "b", 7), ("a", 1, None, None), (None, None, "b", 1), (None, None, None, None)], "artigo_tipo string, artigo_posicao int, det4_tipo string, det4_posicao int")
    assert [r.detector_mais_preciso for r in loops.compared(df).collect()] == ["artigo", "det4", "empate", "artigo", "det4", "nenhum"]


# --- extractor ---


def test_attempts(spark):
    script = extractor.Scripted({"ok": [{"resposta": "{}"}], "t": [{"status_erro": "timeout"}, {"resposta": "{}"}], "v": [{"resposta": " "}], "l": [{"status_erro": "loop", "raciocinio": "abcdef", "loop_inicio": 3}, {"resposta": "{}"}]})
    df = spark.createDataFrame([(k, "p") for k in ("ok", "t", "v", "l")], "chave string, prompt string")
    rows = {k: list(g) for k, g in itertools.groupby(sorted(extractor.attempts(df, script).collect(), key=lambda r: (r.chave, r.tentativa)), key=lambda r: r.chave)}
    assert [len(rows[k]) for k in ("ok", "t", "v", "l")] == [1, 2, 3, 2]
    assert [r.houve_falha for r in rows["v"]] == [False, False, True]
    assert rows["l"][1].prompt.endswith("\nabc")
    off = extractor.attempts(df.where("chave = 'l'"), script, Settings(inject_reasoning=False)).collect()
    assert len(off) == 1 and off[0].houve_falha and off[0].resposta == "{}"


def test_answers(spark):
    df = spark.createDataFrame([(1, '```json\n{"map_nomes": ["Ana", "PERSON 1"], "map_idades": ["3 anos"]}\n```', "[ PERSON 1 ]"), (2, "[1]", ""), (3, "não", ""), (4, None, None)], "id int, r string, c string")
    assert {(r.id, r.tipo, r.termo) for r in extractor.answer_terms(df, "r", "c", "id").collect()} == {(1, "nome", "Ana"), (1, "info", "3 anos")}
    kinds = spark.createDataFrame([('{"classificacao": "nome"}', None), ('{"classificacao": "seguro"}', None), ("{}", None), ('{"classificacao": "x"}', None), (None, "erro")], "r string, e string")
    assert [r.k for r in kinds.select(extractor.review_kind(F.col("r"), F.col("e")).alias("k")).collect()] == ["nome", None, "info", "unknown", "unknown"]


def test_pipeline(spark):
    rec = spark.createDataFrame([(0, "P1", "Ana Lima veio em 31/12/24.", ""), (1, "P2", None, "")], "rec_idx long, prontuario string, descricao string, texto string")
    script = extractor.Scripted({"0": [{"resposta": '{"map_nomes": ["Ana Lima"]}'}], "1": [{"resposta": "{}"}]})
    out, known = pipeline.run(rec.drop("texto"), spark.createDataFrame([], pipeline.KNOWLEDGE), 1, script)
    r = {x.rec_idx: x for x in out.collect()}
    assert re.fullmatch(r"(.)\1{7} veio em \1{8}\.", r[0].mascara) and "PERSON 1" in r[0].anonimizado and r[1].mascara == ""
    assert {(x.tipo, x.texto_original) for x in known.collect()} == {("nome", "Ana Lima"), ("data", "31/12/24")}


# --- sources, sinks, views ---


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"prontuario": "P", "descricao": "x"}, {"prontuario": "Q", "descricao": None}]))
    assert [(r.rec_idx, r.prontuario) for r in readers.read_records(spark, str(tmp_path / "a.json")).orderBy("rec_idx").collect()] == [(0, "P"), (1, "Q")]
    (tmp_path / "a.csv").write_text("título\nprontuario,descricao\nP,um\nQ,dois\n")
    assert [r.descricao for r in readers.read_records(spark, str(tmp_path / "a.csv")).orderBy("rec_idx").collect()] == ["um", "dois"]
    with pytest.raises(ValueError):
        readers.read_records(spark, "a.xml")
    assert readers.read_gold(spark, str(tmp_path / "nada.json")).count() == 0 and readers.read_mask(spark, str(tmp_path / "nada")) == ""
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1_2_mascara_s1-s2_uniao_x.json").write_text('{"metricas": {"precision": 0.5, "recall": 1.0, "f1_score": 0.6, "f2_score": 0.8}}')
    (tmp_path / "m" / "b.fp.json").write_text("{}")
    (tmp_path / "m" / "c.json").write_text("{quebrado")
    r = readers.read_metric_files(spark, str(tmp_path / "m")).collect()
    assert [(x.modo, x.nivel, x.f2_score) for x in r] == [("Uniao", 2, 0.8)]


def test_report_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "B", "*"), (0, "a", "A", None)], "rec_idx long, original string, anonimizado string, mascara string")
    names = sinks.write_report(rows, str(tmp_path / "r"), "x", ("*", "#"))
    assert open(names["original"]).read() == "ab" and readers.read_mask_chars(names["mascara"]) == ("*", "#")
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "k long, a string, b string", ["k"])
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "x", "y")], t.schema))
    t.upsert(spark.createDataFrame([(1, None, "z"), (2, "w", None)], t.schema))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "x", "z"), (2, "w", None)]
    t.insert_absent(spark.createDataFrame([(1, "q", "q"), (3, "n", "n")], t.schema))
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3]


def test_views(spark):
    c = spark.createDataFrame([(1, "artigo", "rep_n", None), (2, "empate", None, "bloco"), (3, "nenhum", None, None)], "log_llm_id long, detector_mais_preciso string, artigo_tipo string, det4_tipo string")
    logs = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, houve_falha boolean")
    assert {r.tecnica_vencedora for r in views.winner_detail(c, logs).collect()} == {"rep_n", "Empate (NULL + bloco)"}
    assert views.winner_bucket(c, logs).count() == 2
    assert views.not_simulated(logs, c.select("log_llm_id")).count() == 0
    k = spark.createDataFrame([("a", "uniao", "g", 0.5, False), ("b", "unico", "g", 0.5, True), ("c", "outro", "g", 1.0, False)], "label_combo string, modo string, grupo string, f2_score double, podado boolean")
    assert {(r.label_combo, r.f2) for r in views.combination_cache(k, "uniao", "g").collect()} == {("a", 0.5), ("b", -1.0)}


def test_entry_without_the_training_package():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_lattice_search_takes_all_sessions_and_levels(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(catalogue.lattice, "search", lambda records, terms, sessions, mode="uniao", depth=None: asked.append((sessions, mode, depth)) or spark.createDataFrame([], "combo array<int>, f2 double, podado boolean"))
    names = {"dataset_registros": "id long, text string, labels array<string>", catalogue.TERMS: "sessao_id long, tipo string, texto_original string, id_local_sessao int"}
    rows = {catalogue.TERMS: [(s, "nome", f"Ana {s}", 1) for s in (5, 1, 8, None, 5)]}
    monkeypatch.setattr(catalogue, "table", lambda s, d, name, *cols: s.createDataFrame(rows.get(name, []), names[name]))
    catalogue.lattice_search(spark, "")
    catalogue.lattice_search_intersect(spark, "")
    assert asked == [([1, 5, 8], "uniao", None), ([1, 5, 8], "interseccao", None)]
    assert {r.texto_original for r in catalogue.knowledge_union_all(spark, "").collect()} == {"Ana 1", "Ana 5", "Ana 8"}
