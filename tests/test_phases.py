"""Stored runs, keyed tables, files, the command line, and what each of them does when it is cut off."""

import json
import random
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from velatura import __main__ as cli
from velatura import session as S
from velatura.config import LoopSettings, Settings
from velatura.operators import extractor, lattice, ngrams, scoring, sessions, spans, tags
from velatura.plans import phases, pipeline
from velatura.sources import artefacts, readers, sinks
from velatura.streaming import loops

LAB = "array<struct<word:string,category:string,subcategory:string,first_position:int,last_position:int>>"
ROOT = Path(__file__).resolve().parents[1]


# --- keyed tables ---


def test_last_row_of_a_key_wins_and_other_buckets_stay(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "k long, a string, b string", ["k"], buckets=4)
    t.upsert(spark.createDataFrame([(i, "x", "y") for i in range(20)], t.schema).coalesce(1))
    before = t._current()[1]
    t.upsert(spark.createDataFrame([(3, "1", None), (3, "2", None), (3, "3", None)], t.schema).coalesce(1))
    after = t._current()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    assert [tuple(r) for r in t.read().where("k = 3").collect()] == [(3, "3", "y")] and t.read().count() == 20
    t.upsert(spark.createDataFrame([(3, None, None)], t.schema), keep_null=False)
    assert t.read().where("k = 3").first().a is None
    t.upsert(t.read().limit(0))
    t.insert_absent(spark.createDataFrame([(None, "n", "n"), (3, "q", "q")], t.schema))
    t.insert_absent(spark.createDataFrame([(None, "m", "m")], t.schema))
    assert t.read().count() == 21 and t.read().where("k IS NULL").first().a == "n"
    t.overwrite(t.read().where("k < 5"))
    assert t.read().count() == 5


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "k long, a string", ["k"], buckets=2)
    t.upsert(spark.createDataFrame([(1, "x")], t.schema))
    other = sinks.VersionedTable(spark, t.path, t.schema, ["k"], buckets=2)
    real, fired = t._publish, []

    def late(number, manifest):
        if not fired:
            fired.append(1)
            other.upsert(spark.createDataFrame([(2, "y")], t.schema))
        return real(number, manifest)

    monkeypatch.setattr(t, "_publish", late)
    t.upsert(spark.createDataFrame([(3, "z")], t.schema))
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3]
    monkeypatch.setattr(t, "_publish", lambda *a: (_ for _ in ()).throw(sinks.Conflict()))
    with pytest.raises(sinks.Conflict):
        t.upsert(spark.createDataFrame([(4, "w")], t.schema))


def test_sessions(spark, tmp_path):
    t = sessions.store(spark, str(tmp_path / "s"))
    assert sessions.find(t, "N", "m") == -1
    a, b = sessions.get_or_create(t, "N", "m"), sessions.get_or_create(t, "N", "m2")
    assert (a, b) == (1, 2) and sessions.get_or_create(t, "N", "m") == 1
    sessions.update(t, 1, status="fim", tags=("⦃", "⦄"))
    row = sessions.by_id(t.read(), 1).first()
    assert (row.nome_identificador, row.status) == ("N [m]", "fim") and sessions.tag_characters(t.read(), 1) == ("⦃", "⦄")
    assert sessions.tag_characters(t.read(), 2) == sessions.tag_characters(t.read(), 9) == (None, None)


# --- phases ---

TEXTS = ["Ana Lima veio hoje com dor no peito. Orientada a voltar se houver febre alta.", "Bia Souza voltou. Orientada a voltar se houver febre alta", "", "Nega queixas.\nAna Lima acompanha a consulta de rotina.", "Caio pediu receita nova do remédio de uso contínuo."]
NAMES = [["Ana Lima"], ["Bia Souza"], [], ["Ana Lima"], ["Caio"]]


def _script():
    answers = {str(i): [{"resposta": json.dumps({"map_nomes": n})}] for i, n in enumerate(NAMES)}
    answers["1"] = [{"status_erro": "timeout"}, *answers["1"]]
    answers["4"] = [{"resposta": '{"duvidas_pendentes": ["Caio"]}'}]
    return extractor.Scripted(answers)


def _records(spark):
    return spark.createDataFrame([(i, f"P{i}", t, t) for i, t in enumerate(TEXTS)], "rec_idx long, prontuario string, texto string, bruto string")


def _state(t):
    return sorted((r.tipo, r.texto_original, r.id_local_sessao) for r in t.of(1).collect()), sorted((r.evolucao_index, r.rodada, r.tentativa, r.houve_falha, r.houve_duvida) for r in t.log().collect())


def test_a_stopped_run_ends_like_an_uninterrupted_one(spark, tmp_path):
    whole, parts = phases.Tables(spark, str(tmp_path / "a")), phases.Tables(spark, str(tmp_path / "b"))
    assert phases.row_phase(whole, _records(spark), 1, _script(), "⦃", "⦄", batch=2) == 3
    assert phases.row_phase(parts, _records(spark), 1, _script(), "⦃", "⦄", batch=2, batches=1) == 1
    # cut off after the knowledge was saved, before the log: the batch is done again
    known, _ = phases.learn_batch(_records(spark).where("rec_idx IN (2, 3)"), parts.of(1), 1, _script(), "⦃", "⦄", Settings())
    parts.knowledge.upsert(known)
    assert phases.row_phase(parts, _records(spark), 1, _script(), "⦃", "⦄", batch=2) == 2
    assert _state(whole) == _state(parts)
    terms, log = _state(whole)
    assert ("nome", "Ana Lima", 1) in terms and ("revisao", "Caio", 1) in terms
    assert {"veio hoje com dor no peito", "Orientada a voltar se houver febre alta."} & {x for k, x, _ in terms if k == "boilerplate"}
    assert [x[1:3] for x in log if x[0] == 4] == [(1, 1), (2, 2)] and [x[2] for x in log if x[0] == 1] == [1, 2]
    assert phases.row_phase(parts, _records(spark), 1, _script(), "⦃", "⦄") == 0
    assert phases.row_phase(parts, _records(spark).limit(0), 1, _script(), "⦃", "⦄") == 0


def test_a_whole_run_can_be_called_again(spark, tmp_path):
    t = phases.Tables(spark, str(tmp_path / "w"))
    rec = _records(spark).select("rec_idx", "prontuario", F.col("texto").alias("descricao"))
    script = extractor.Scripted(_script().answers | {"Caio": [{"resposta": '{"classificacao": "nome"}'}]})
    first = {r.rec_idx: r for r in phases.whole_run(t, rec, 1, script, batch=2).collect()}
    assert "Ana" not in first[0].anonimizado and "Caio" not in first[4].anonimizado and len(first[0].mascara) == len(TEXTS[0]) and first[2].mascara == ""
    log = t.log().count()
    again = {r.rec_idx: r for r in phases.whole_run(t, rec, 1, script, batch=2).collect()}
    assert again == first and t.log().count() == log


def test_review(spark, tmp_path):
    t = phases.Tables(spark, str(tmp_path / "r"))
    rows = [(1, "revisao", x, i + 1) for i, x in enumerate(["Ana", "dor", "Rua A", "quebrado", "outro"])] + [(1, "nome", "Bia", 1), (2, "revisao", "fica", 1)]
    t.knowledge.upsert(spark.createDataFrame(rows, pipeline.KNOWLEDGE))
    script = extractor.Scripted({"Ana": [{"resposta": '{"classificacao": "nome"}'}], "dor": [{"resposta": '{"classificacao": "seguro"}'}], "Rua A": [{"resposta": '```json\n{"classificacao": "endereco"}\n```'}], "quebrado": [{"status_erro": "erro"}], "outro": [{"resposta": "{}"}]})
    assert phases.review_phase(t, 1, script) == 5 and phases.review_phase(t, 1, script) == 0
    got = {(r.tipo, r.texto_original, r.id_local_sessao) for r in t.of(1).where("tipo <> 'revisao_arquivada'").collect()}
    assert got == {("nome", "Bia", 1), ("nome", "Ana", 2), ("endereco", "Rua A", 1), ("unknown", "quebrado", 1), ("info", "outro", 1)}
    assert t.of(1).where("tipo = 'revisao_arquivada'").count() == 5 and t.of(2).count() == 1


def test_phrases_by_verdict(spark, tmp_path):
    t = phases.Tables(spark, str(tmp_path / "n"))
    body = "paciente orientada a retornar em caso de dor"
    rows = [(i, f"P{i}", f"{body}. assinado por rosa maria lima. talvez caio seja parente próximo. lixo sem resposta aqui") for i in range(6)]
    rec = spark.createDataFrame(rows, "rec_idx long, prontuario string, texto string")
    answers = {"assinado por rosa maria": [{"resposta": '{"map_nomes": ["rosa maria"]}'}], "talvez caio seja parente": [{"resposta": '{"duvidas_pendentes": ["caio"]}'}], "lixo sem resposta aqui": [{"resposta": "não sei"}]}

    answers |= {"paciente orientada a retornar": [{"resposta": "{}"}]}
    s = Settings(ngram_min=4, ngram_max=4, min_subjects=5)
    assert phases.ngram_phase(t, rec, 1, extractor.Scripted(answers), "⦃", "⦄", s) == 1
    got = {(r.tipo, r.texto_original) for r in t.of(1).collect()}
    assert got == {("boilerplate", "paciente orientada a retornar"), ("nome", "rosa maria"), ("revisao", "talvez caio seja parente")}
    assert t.resume(1, s) == (-1, 4) and phases.ngram_phase(t, rec, 1, extractor.Scripted(answers), "⦃", "⦄", s) == 0


def test_a_level_is_left_when_all_its_phrases_are_judged(spark):
    rows = [(f"P{s}", s, [0], [f"a{k}", f"b{k}"]) for s in range(3) for k in range(7)]
    frags = spark.createDataFrame(rows, "subject string, rec long, frag array<int>, tokens array<string>")
    frags = frags.withColumn("rec", F.monotonically_increasing_id())
    seen = []
    ngrams.mine(frags, 2, 2, 3, verdict=lambda some: seen.append(len(some)) or [], page=3)
    assert seen == [3, 3, 1]


def test_parts_of_fragments_keep_their_own_place(spark):
    """A fragment cut in more than a thousand parts: no two parts share a place."""
    frags = spark.createDataFrame([("A", 1, [0], ["x", "y"] * 1_500), ("A", 1, [1], ["x", "z"])], "subject string, rec long, frag array<int>, tokens array<string>")
    cut = ngrams.without_phrases(frags, ["x"])
    assert cut.count() == cut.select("rec", "frag").distinct().count() == 1_501


def test_marks_and_lists(spark):
    rec = spark.createDataFrame([(0, "Ana, Lima e ana lima; Analima"), (1, None)], "rec_idx long, texto string")
    none = spark.createDataFrame([], pipeline.KNOWLEDGE)
    out, known = tags.mark_for_review(rec, none, 1, "Ana Lima", "⦃", "⦄")
    assert {r.rec_idx: r.texto for r in out.collect()} == {0: "⦃ REVIEW 1 ⦄ e ⦃ REVIEW 1 ⦄; Analima", 1: None} and known.count() == 1
    out, _ = tags.mark_for_review(rec, none, 1, "e ana", "⦃", "⦄", "boilerplate")
    assert out.first().texto == "Ana, Lima  ⦃ BOILERPLATE 1 ⦄  lima; Analima"
    out, known = tags.replace_listed(rec, none, 1, {"nome": ["Ana", "Ana, Lima"], "endereco": []}, "⦃", "⦄")
    assert out.where("rec_idx = 0").first().texto == "⦃ PERSON 2 ⦄ e ana lima; ⦃ PERSON 1 ⦄lima"


def _chat():
    def chat(prompt, options):
        if prompt == "laço":
            for _ in range(100):
                yield {"thinking": "gira "}
            raise AssertionError("not stopped")
        if prompt == "tempo":
            yield {"content": "meio"}
            raise TimeoutError
        if prompt == "quebra":
            raise OSError("sem rede")
        yield {"content": "<think>penso</think> "}
        yield {"content": "digo", "done": True, "done_reason": "length" if prompt == "longo" else "stop", "eval_count": 10, "eval_duration": 2_000_000_000, "total_duration": 3_000_000_000}

    return chat


def test_streamed_answers():
    ticks = iter(range(1000))
    ask = extractor.Streamed(_chat(), ("m",), clock=lambda: next(ticks))
    ok = ask("p", {})
    assert (ok["raciocinio"], ok["resposta"], ok["status_erro"]) == ("penso", "digo", None) and ok["metricas"]["eval_tokens_per_second"] == 5.0 and ok["metricas"]["total_duration_sec"] == 3.0
    loop = ask("laço", {})
    assert loop["status_erro"] == "loop:janela_exata" and loop["loop_inicio"] == 0 and loop["metricas"]["eval_count"] == 60 and len(loop["raciocinio"]) == 300
    assert ask("tempo", {})["status_erro"] == "timeout" and ask("tempo", {})["resposta"] == "meio"
    assert ask("quebra", {})["status_erro"] == "erro: sem rede" and ask("longo", {})["status_erro"] == "erro_stop_reason"
    assert ask.has_model("casa:m") and not ask.has_model("x")


def test_streamed_answers_as_attempts(spark):
    df = spark.createDataFrame([("a", "laço"), ("b", "p")], "chave string, prompt string")
    rows = {(r.chave, r.tentativa): r for r in extractor.attempts(df, extractor.Streamed(_chat())).collect()}
    assert rows["a", 1].status_erro.startswith("loop") and not rows["a", 1].final and rows["b", 1].resposta == "digo"


def test_encoder_and_profiles(spark, monkeypatch):
    from velatura.config import settings_for
    from velatura.functions import text

    df = spark.createDataFrame([("ab c",), (None,), ("",), ("!",)], "t string")
    make = lambda: lambda t: 1 / 0 if t == "!" else t.split()
    assert [r.n for r in df.select(text.encoded_count(F.col("t"), make).alias("n")).collect()] == [2, -1, 0, -1]
    profiles = {"a": Settings(), "b": Settings(attempts=1)}
    assert settings_for(profiles, "a", "b").attempts == 1 and settings_for(profiles, "a", "z").attempts == 3
    monkeypatch.setenv("VELATURA_PROFILE", "b")
    assert settings_for(profiles, "a").attempts == 1


# --- both ways of applying a dictionary ---


def test_joined_dictionary_equals_the_held_one(spark):
    rng = random.Random(2)
    words = ["ana", "Ana", "de", "r.", "13/01", "São", "paulo", "39", "anos", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 20))) for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_idx long, texto string")
    rows = [(1, rng.choice(["nome", "endereco", "info", "unknown"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), i) for i in range(40)] + [(1, "info", "39 anos", 99)]
    know = spark.createDataFrame(rows, pipeline.KNOWLEDGE)
    terms = know.select(F.col("texto_original").alias("termo"), "tipo").distinct()
    get = lambda n: sorted(map(tuple, spans.dictionary_spans(df, terms, limit=n).select("rec_idx", "ini", "fim", "termo", "tipo").collect()))
    assert get(0) == get(1000) != []
    cover = lambda n: sorted(spans.masks(df, know, ("#", "?"), limit=n).collect())
    assert cover(0) == cover(1000)


def test_overlaps_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        xs = [(f"{rng.randint(0, 9)}", s := rng.randint(0, 40), s + rng.randint(0, 8), "#") for _ in range(rng.randint(0, 25))]
        kept = []
        for x in sorted(xs):
            if x[2] > x[1] and all(x[2] <= k[1] or k[2] <= x[1] for k in kept):
                kept.append(x)
        assert spans.accepted_by_rank(xs) == sorted(kept, key=lambda k: k[1])


def test_lattice_counts_records_without_a_term(spark):
    """A record that holds no term of a combination counts as its patterns alone leave it."""
    t = ["Ana veio em 31/12/24", "nada aqui 30/11/24 Bia"]
    rec = spark.createDataFrame([(i, x, [("Ana", "c", "PATIENT", 0, 3)] if i == 0 else [("Bia", "c", "PATIENT", 19, 22)]) for i, x in enumerate(t)], f"rec_idx long, texto string, labels {LAB}")
    k = spark.createDataFrame([(1, "nome", "Ana", 1), (2, "nome", "zzz", 1)], "sessao_id int, tipo string, texto_original string, id_local_sessao int")
    combos = spark.createDataFrame([([1],), ([2],)], "combo array<int>")
    got = {tuple(r.combo): (r.tp, r.fn, r.fp) for r in lattice.score_level(combos, lattice.base_scores(rec), k, "uniao").collect()}
    assert got == {(1,): (1, 1, 2), (2,): (0, 2, 2)}


# --- files ---


def test_csv_with_line_breaks_in_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('relatório de "x"\nprontuario,extra,descricao\nP,1,"um\nem duas, linhas ""a"""\nQ,2,dois\n')
    rows = readers.read_records(spark, str(tmp_path / "a.csv")).orderBy("rec_idx").collect()
    assert [(r.prontuario, r.descricao) for r in rows] == [("P", 'um\nem duas, linhas "a"'), ("Q", "dois")]
    (tmp_path / "b.csv").write_text("só um título\n")
    assert readers.read_records(spark, str(tmp_path / "b.csv")).count() == 0


def test_mask_files_in_pieces(spark, tmp_path):
    rng = random.Random(4)
    lengths = [rng.randint(0, 9) for _ in range(40)]
    mask = "".join(rng.choice("ab#\n") for _ in range(sum(lengths) - 5))
    (tmp_path / "m.txt").write_text(mask)
    pieces = readers.mask_pieces(spark, f"file://{tmp_path}/m.txt", size=7)
    assert pieces.count() == -(-len(mask) // 7) and readers.mask_pieces(spark, str(tmp_path / "nada")).count() == 0
    recs = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    got = {r.id: (r.mascara, r.inteira) for r in scoring.slice_pieces(recs, pieces, "id", "n", size=7).collect()}
    at = 0
    for i, n in enumerate(lengths):
        if n and at < len(mask):
            assert got[i] == (mask[at : at + n], at + n <= len(mask))
        at += n


def _masked_records(spark):
    t = "Paciente Maria Silva mora em Maceió."
    labels = [("Maria Silva", "c", "PATIENT", 9, 20), ("Maceió", "c", "CITY", 29, 35)]
    return spark.createDataFrame([(1, t, labels, "Paciente ########### m### em Maceió."), (2, "x", None, "x")], f"id long, text string, labels {LAB}, mascara string")


def test_score_files(spark, tmp_path):
    rec, out = _masked_records(spark), str(tmp_path / "s")
    assert sinks.write_scores(rec.limit(0), out, ("#", "?")) is None
    assert sinks.write_scores(rec, out, ("#", "?")) == out
    r = spark.read.json(f"{out}/totais").first()
    assert (r.tp, r.fn, r.fp, r.recall, r.precision, r.f2) == (1, 1, 1, 0.5, 0.5, 0.5)
    v = spark.read.json(f"{out}/visual").where("id = 1").first()
    assert v.fn_visual == "." * 29 + "Maceió." and v.fp_visual[21:25] == ".ora" and set(v.fp_visual) == set(".ora")
    assert {x.termo for x in spark.read.json(f"{out}/fn").collect()} == {"Maceió"}
    assert sinks.write_scores(rec.limit(0), out, ("#", "?")) == out  # kept
    a = scoring.alignment(rec.withColumn("mascara", F.when(F.col("id") == 2, "yy").otherwise(F.col("mascara"))), "id", "text", "mascara", ("#", "?")).first()
    assert (a.avaliados, a.desalinhados, a.primeiros) == (2, 1, [2])


def test_gold_files_are_blocked_by_wrong_labels(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, f"id long, text string, labels {LAB}, synthetic boolean")
    good = make([(1, "A <X>Ana</X/> b", [("Ana", "c", "X", 5, 8)], None), (2, "sintético", None, True), (3, "c", None, False)])
    also, bad = make([(9, "d", None, None)]), make([(1, "<X>Ana</X/>", [("Eva", "c", "X", 3, 6), ("Ana", "c", "X", 30, 33)], None), (2, "<X>Bia</X/>", [("Bia", "c", "X", 3, 6)], None)])
    assert sinks.write_gold({"a": good, "b": also}, str(tmp_path / "g")) == {"a": 2, "b": 1, "FULL": 3}
    assert sorted((r.prontuario, r.descricao) for r in spark.read.json(str(tmp_path / "g" / "FULL")).collect()) == [(875, "A Ana b"), (876, "c"), (877, "d")]
    assert "bad" not in sinks.write_gold({"só": bad.where("id = 2")}, str(tmp_path / "h"))


def test_artefacts(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir()
    for n in ("20240101_000000_mascara_s_m.txt", "20250101_000000_mascara_s_m.txt", "20250101_000000_mascara_s_m.meta.json", "20250101_000000_original_s_m.txt", "mascara_s_m2.txt"):
        (old / n).write_text("x")
    found = artefacts.find_mask(spark, [str(tmp_path / "nada"), str(old)], "s", "m")
    assert found.endswith("20250101_000000_mascara_s_m.txt") and artefacts.find_mask(spark, [str(old)], "s", "x") is None
    assert len(artefacts.move(spark, found, str(new))) == 4 and [p.name for p in old.iterdir() if p.suffix != ".crc"] == ["mascara_s_m2.txt"]
    assert artefacts.delete(spark, f"{new}/20250101_000000_mascara_s_m.txt") == 4


def test_command_line(spark, tmp_path):
    _masked_records(spark).write.parquet(str(tmp_path / "in"))
    assert cli.main(["score", str(tmp_path / "in"), str(tmp_path / "out"), "--chars", "#?"], spark) == 0
    assert spark.read.json(str(tmp_path / "out" / "totais")).count() == 1
    assert cli.main(["loops", str(tmp_path / "in"), str(tmp_path / "l"), "--column", "text", "--detectors", "1,4"], spark) == 0
    (tmp_path / "r.json").write_text(json.dumps([{"prontuario": "P", "descricao": f"Ana {i}"} for i in range(4)]))
    spark.createDataFrame([(1, "nome", "Ana", 1)], pipeline.KNOWLEDGE).write.parquet(str(tmp_path / "k"))
    assert cli.main(["mask", str(tmp_path / "r.json"), str(tmp_path / "k"), str(tmp_path / "m"), "--session", "1", "--from", "1", "--to", "3"], spark) == 0
    assert sorted(r.rec_idx for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 2]
    with pytest.raises(SystemExit):
        cli.main(["nada"], spark)


# --- session folder, entry, streams ---


def test_a_cluster_must_name_its_folder():
    fake = lambda master, folder=None: SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"{master}{folder}", master=master), conf=SimpleNamespace(get=lambda k, d: folder))
    for master in ("spark://h:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            S.shared_dir(fake(master))
        assert S.shared_dir(fake(master, "/shared")).startswith("/shared/velatura-")
    for master in ("local", "local[*]", "local[8]", "local[2, 3]"):
        assert S.shared_dir(fake(master)).startswith("file:///")


def test_the_rest_works_with_both_folders_deleted(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r")})
    done = run("import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n[0] == 'p' and n[1].isdigit() for n in q))")
    assert done.returncode == 0 and done.stdout.split()[1] == "False", done.stderr
    (tmp_path / "r" / "velatura" / "llm").mkdir()
    (tmp_path / "r" / "velatura" / "llm" / "__init__.py").write_text("")
    (tmp_path / "r" / "velatura" / "llm" / "queries.py").write_text("import nicht_da")
    assert "nicht_da" in run("import __spark_entry__").stderr  # a missing library isn't taken for a missing package


def test_a_missing_chunk_is_told(spark):
    p = loops._LoopProcessor(LoopSettings(), None, 3)
    store = SimpleNamespace(exists=lambda: False, update=lambda x: None)
    p.state, p.lines = store, SimpleNamespace(exists=lambda: False, get=lambda: [], appendList=lambda x: None, clear=lambda: None)
    import pandas as pd

    early = lambda n: iter([pd.DataFrame({"q": range(1, n + 1), "c": ["x"] * n})])
    assert list(p.handleInputRows(("a",), early(3), None)) == []
    with pytest.raises(ValueError, match="chunk 0 is missing"):
        list(p.handleInputRows(("a",), early(4), None))


def test_a_long_text_takes_time_in_proportion():
    import time

    def took(n):
        t, d = "\n".join(f"linha {i} palavra{i * 7} outra{i * 3}" for i in range(n)), loops.LoopDetector()
        began = time.process_time()
        for k in range(0, len(t), 8):
            assert d.feed(t[k : k + 8]) is None
        return time.process_time() - began

    assert took(20_000) < 12 * max(took(4_000), 0.05)
