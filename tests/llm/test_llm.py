import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velatura.llm import bpe, mixing, overlap, pairs, percentiles, personal, repetition, sentences, site_lines, truncation

# --- 1: overlap ---


def _words(rng, n):
    return [rng.choice("paciente dor no peito nega febre alta com uso de losartana rio mar sol lua casa ana bia".split()) + str(rng.randint(0, 9) if rng.random() < 0.3 else "") for _ in range(n)]


def _brute(rows, share=0.8):
    ws = {i: overlap.words(t) for i, t, *_ in rows}
    out = set()
    for (i, t, s, _), (j, u, z, _) in itertools.combinations(rows, 2):
        a, b = ws[i], ws[j]
        if (s == "training") != (z == "training") and a and b and i != j and overlap.common_words(a, b) >= share * max(len(a), len(b)) - 1e-9:
            out.add((min(i, j), max(i, j)))
    return out


SCHEMA = "id long, text string, split string, source string"


def test_overlap_against_brute_force(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for k in range(60):
        base = _words(rng, rng.choice([3, 6, 11, 14, 40, 90]))
        for _ in range(2):
            ws = base[:]
            for _ in range(rng.randint(0, max(1, len(ws) // 12))):
                ws[rng.randrange(len(ws))] = rng.choice(["xx", "yy", "Rio"])
            rows.append((n, rng.choice([" ", "  ", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in ws), rng.choice(["training", "test", None]), "s"))
            n += 1
    rows += [(900, None, "training", None), (901, "", "test", None), (902, "...", "test", "s"), (903, "Ação já!", "test", "s"), (904, "acao JA", "training", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("norm", F.lit(1))  # a clashing extra column
    links, members = overlap.cross_split(df)
    got = {(r.id_a, r.id_b) for r in overlap.row_pairs(links, members).collect()}
    assert got == _brute(rows) and (903, 904) in got
    rep = overlap.overlap_report(links, members).collect()
    assert sum(r.ligacoes for r in rep) == len(got)


def test_overlap_with_every_kind_of_edit_and_split_keys(spark):
    """Replaced, deleted and inserted words, up to a fifth and beyond; 26 and 27 words with 22 in common; words that are in most texts."""
    rng = random.Random(11)
    rows, n = [], 0
    for k in range(70):
        base = _words(rng, rng.choice([5, 8, 15, 20, 26, 27, 45, 99, 100]))
        for edit in range(3):
            ws = base[:]
            for _ in range(round(len(ws) * rng.uniform(0, 0.28))):
                at = rng.randrange(len(ws))
                kind = rng.randrange(3)
                if kind == 0:
                    ws[at] = f"w{rng.randint(0, 40)}"
                elif kind == 1 and len(ws) > 1:
                    del ws[at]
                else:
                    ws.insert(at, rng.choice(["rio", "mar", f"w{rng.randint(0, 40)}"]))
            rows.append((n, " ".join(ws), "training" if edit == 0 else "test", "s"))
            n += 1
    long = [f"c{i}" for i in range(22)]
    x, y = long[:], long[:]
    for at in (4, 9, 14, 19):
        x.insert(at, f"x{at}")
        y.insert(at, f"y{at}")
    rows += [(900, " ".join(x), "training", "s"), (901, " ".join([*y, "z"]), "test", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows)
    assert (900, 901) in want and len(want) > 60
    for salt_rows in (overlap.SALT_ROWS, 5):
        links, members = overlap.cross_split(df, salt_rows=salt_rows)
        assert {(r.id_a, r.id_b) for r in overlap.row_pairs(links, members).collect()} == want


def test_overlap_of_nothing(spark):
    links, members = overlap.cross_split(spark.createDataFrame([], SCHEMA))
    assert overlap.row_pairs(links, members).count() == 0 and overlap.overlap_report(links, members).count() == 0


def test_overlap_copies_are_one_class(spark):
    text = " ".join(f"palavra{i}" for i in range(30))
    rows = [(i, text, "training" if i % 2 else "test", "s") for i in range(40)]
    links, members = overlap.cross_split(spark.createDataFrame(rows, SCHEMA))
    assert links.count() == 1 and overlap.row_pairs(links, members).count() == 400


def test_overlap_however_the_changes_lie(spark):
    def text(words):
        return " ".join(words)

    def swap(words, at):
        return [f"novo{i}" if i in at else w for i, w in enumerate(words)]

    rows = []
    for n, at in ((14, {4, 9}), (15, {4, 9, 12}), (20, {3, 8, 13, 18}), (25, {4, 9, 14, 19, 24}), (100, set(range(4, 100, 5)))):  # no five words in a row stay
        base = [f"p{n}x{i}" for i in range(n)]
        rows += [(text(base), "training"), (text(swap(base, at)), "test")]
    long, rng = [f"q{i}" for i in range(100)], random.Random(3)
    short = swap(long, {5, 11, 17, 23, 29, 35, 41, 47, 53, 59, 65, 71, 77, 83, 89})[:99]  # what both share is the template of many
    rows += [(text(long), "training"), (text(short), "test")]
    rows += [(text([*(f"r{k}x{i}" for i in range(60)), *rng.sample(long, 60)]), rng.choice(["training", "test"])) for k in range(30)]
    rows = [(i, t, s, "s") for i, (t, s) in enumerate(rows)]
    links, members = overlap.cross_split(spark.createDataFrame(rows, SCHEMA))
    got = {(r.id_a, r.id_b) for r in overlap.row_pairs(links, members).collect()}
    assert got == _brute(rows) and {(i, i + 1) for i in range(0, 12, 2)} <= got


def test_overlap_keys_miss_no_partner_and_few_texts_of_one_template_meet():
    rng, share = random.Random(7), 0.8
    sentences = [[f"s{k}w{i}" for i in range(12)] for k in range(40)]  # each word is in a quarter of the texts: by single words most texts meet

    def text():
        return [w if rng.random() < 0.7 else f"{w}v{rng.randrange(30)}" for s in rng.sample(sentences, 10) for w in s][: rng.randint(60, 120)]

    texts = [text() for _ in range(300)]
    for n in (1, 2, 4, 5, 9, 26, 99, 700):
        texts += [[f"w{rng.randrange(n)}" for _ in range(n)] for _ in range(3)]
    changed = []
    for ws in texts:
        ws, kind = ws[:], rng.choice(["replace", "delete", "insert", "all"])
        for _ in range(rng.randint(0, max(1, len(ws) // 4))):
            k = rng.choice(["replace", "delete", "insert"]) if kind == "all" else kind
            at = rng.randrange(len(ws))
            if k == "insert":
                ws.insert(at, f"n{rng.randrange(50)}")
            elif k == "delete" and len(ws) > 1:
                del ws[at]
            else:
                ws[at] = f"n{rng.randrange(50)}"
        changed.append(ws)
    hs, _ = overlap._hashes(texts + changed, overlap._Known())
    cells = np.bincount(np.concatenate(hs) & 0xFFFFF, minlength=1 << 20)
    rank = np.empty(1 << 20, dtype=np.int32)
    rank[np.argsort(-cells, kind="stable")] = np.arange(1 << 20)
    for dims in (2, 3, 5):
        keys = [set() for _ in hs]
        for i, k in zip(*(x.tolist() for x in overlap.covering_keys(hs, rank, overlap._Lengths(share, dims)))):
            keys[i].add(k)
        near = [i for i, (a, b) in enumerate(zip(texts, changed)) if overlap.common_words(a, b) >= share * max(len(a), len(b)) - 1e-9]
        assert len(near) > 150 and all(keys[i] & keys[len(texts) + i] for i in near)
    assert sum(bool(keys[i] & keys[j]) for i in range(300) for j in range(i)) < 0.1 * 300 * 299 / 2


def test_words_of_latin_and_other_texts():
    assert overlap.words("ÀÇÃO_2º m² ¼ straße–x 'Æon' ´a µg ﬁm") == ["acao", "2o", "m2", "1", "4", "strasse", "x", "æon", "a", "μg", "fim"]
    for code in (*range(0x250), 0x130, 0x3A3, 0x2013):
        assert overlap.words(f"a{chr(code)}b") == overlap._WORD.findall(overlap.unicodedata.normalize("NFKD", f"a{chr(code)}b".casefold()).translate(overlap._PLAIN))


# --- 2: percentiles ---


def test_leaf_order_and_values():
    v = np.array([-np.inf, -1e300, -2.5, -1e-40, -0.0, 0.0, 1e-40, 0.1, 3.0, 1e300, np.inf])
    leaf = percentiles.leaf_of(v)
    assert (np.diff(leaf) >= 0).all() and leaf.min() >= 0 and leaf.max() < 1 << 32
    assert np.allclose(percentiles.value_of(percentiles.leaf_of(np.array([0.1, 3.0, -2.5]))), [0.1, 3.0, -2.5], rtol=1e-6)


@pytest.mark.parametrize("eps", [0.1, 0.02])
def test_percentiles_keep_their_bound_when_merged(spark, eps):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.lognormal(2, 1, 20_000), np.full(4_000, 7.0), -rng.random(500)])
    df = spark.createDataFrame([(None if i % 97 == 0 else "a", i % 3, float(x), None if i % 5 else float("nan")) for i, x in enumerate(v)], "g string, dia int, x double, y double").repartition(6).withColumn("chave", F.lit(1))
    parts = [percentiles.digest(df.where(c), ["g", "dia"], ["x", "y"], eps) for c in (F.col("x") < 5, F.col("x") >= 5)]
    qs = [0.01, 0.5, 0.9, 0.999]
    rows = percentiles.read(percentiles.merge(*parts, by=["g"], eps=eps), by="g", quantiles=qs, eps=eps).collect()
    assert {r.g for r in rows} == {"a", None} and {r.metrica for r in rows} == {"x"}
    assert {(x.g, x.n) for x in rows} == {(x.g, x.n) for x in percentiles.read(*parts, by="g", quantiles=qs, eps=eps).collect()}
    r = next(r for r in rows if r.g == "a")
    mine = np.sort(v[np.arange(len(v)) % 97 != 0])
    assert r.n == len(mine) and r.erro_posto <= eps * r.n
    for q, name in zip(qs, ("p0010", "p0500", "p0900", "p0999")):
        x = r[name] * (1 + 1e-6 * np.sign(r[name]))
        low, high = np.searchsorted(mine, x * (1 - 2e-6 * np.sign(x)), "left"), np.searchsorted(mine, x, "right")
        assert low - eps * r.n <= q * r.n <= high + eps * r.n + 1
    nodes = percentiles.merge(*parts, by="g", eps=eps).where("g = 'a'").count()
    assert nodes <= 3 * (percentiles.BITS / eps) + 10


def test_a_hot_group_is_folded_in_parts(spark):
    """One group in all of 64 partitions: no task of the last fold gets more than sqrt(64) folded parts."""
    eps, k = 0.1, 320
    df = spark.range(200_000, numPartitions=64).select(F.lit("quente").alias("g"), F.rand(1).alias("x"))
    nodes = df.select(percentiles._key(["g"]).alias("chave"), "x").mapInArrow(percentiles._digests(k, ["x"], 8), percentiles._NODES)
    per = nodes.repartition("metrica", "chave", "parte").sortWithinPartitions("parte", "metrica", "chave").mapInPandas(percentiles._groups(k, percentiles._nodes), percentiles._NODES)
    raw, folded = nodes.count(), per.count()
    assert nodes.select("parte").distinct().count() == 8 and folded <= 8 * 3 * k < raw / 4
    r = percentiles.read(percentiles.digest(df, "g", ["x"], eps), by="g", quantiles=[0.5], eps=eps).first()
    assert r.n == 200_000 and abs(r.p0500 - 0.5) < eps


def test_a_group_that_does_not_fit_is_folded_while_it_is_read(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(percentiles, "_FLUSH", 500)
    k, rng = 40, np.random.default_rng(1)
    x = rng.random(50_000)
    seen = []
    real = percentiles.compress
    monkeypatch.setattr(percentiles, "compress", lambda g, v, c, k: seen.append(len(v)) or real(g, v, c, k))
    frames = (pd.DataFrame({"chave": "a", "metrica": "x", "no": percentiles.leaf_of(p) + (1 << 32), "n": 1}) for p in np.split(x, 500))
    out = pd.concat(percentiles._groups(k, percentiles._nodes)(frames))
    assert out["n"].sum() == 50_000 and max(seen) < 1_000
    got = percentiles._read([0.5], k)(["a"], ["x"], np.zeros(len(out), int), out["no"].to_numpy(), out["n"].to_numpy()).iloc[0]
    assert abs((x <= got.p0500).sum() - 25_000) <= got.erro_posto + 2


def test_percentiles_small_groups_are_exact_and_empty_ones_missing(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", None), ("c", float("inf"))], "g string, x double")
    got = {r.g: (r.n, r.p0500) for r in percentiles.read(percentiles.digest(df, "g", ["x"]), by="g", quantiles=[0.5]).collect()}
    assert got == {"a": (3, 2.0), "c": (1, float("inf"))}
    assert percentiles.read(percentiles.digest(df.limit(0), "g", ["x"]), by="g", quantiles=[0.5]).count() == 0


# --- 3 and 7: truncation, pairs ---


@pytest.mark.parametrize(
    "text, want",
    [
        (None, "vazio"), ("  ", "vazio"), ("```json\n```", "vazio"), ("null", "vazio"), ("[]", "vazio"), ("...", "vazio"), ("\n" * 900, "vazio"), ("-" * 900, "vazio"),
        ('{"map_nomes": []}', "inteiro"), ('```json\n{"a": [1]}\n```', "inteiro"), ('{"a": "x \\" y"}\nObs.: nada.', "inteiro"),
        ('{"a": ["b"', "estrutura"), ('{"a": "b', "estrutura"), ('{"a": "\\u00', "estrutura"), ('```json\n{"a": 1}', "estrutura"), ('{"a": 1}\nObs.: mar', "aberto"),
        ("Terminou bem.", "inteiro"), ("Encerrado…", "inteiro"), ("Restou dúvida? Não.", "inteiro"), ("Vou entregar o objeto:", "inteiro"), ("终于完成。", "inteiro"), ('Ele disse "sim."', "inteiro"),
        ('{"a": 1]', "estrutura"), ('{"a": [1}, "b": 2', "estrutura"), ('Ele disse "vou embora.', "estrutura"), ("<b>texto.", "estrutura"), ("<p>um <b>dois</b>.</p>", "inteiro"), ("linha<br>outra.", "inteiro"), ("Segue <PATIENT>Ana</PATIENT/>.", "inteiro"), ("Fim. </p", "estrutura"),
        ("Disse “não. Depois saiu.", "estrutura"), ("Uma linha “aberta\nOutra fechada.", "inteiro"), ('Tubo de 5" e nada mais.', "inteiro"), ("Texto (com nota.", "estrutura"), ("Tudo bem :( hoje.", "inteiro"), ('"""\nTexto copiado.\n"""', "inteiro"), ("Depois de ler a no\ufffd", "estrutura"), ("fim \\u00e", "estrutura"), ("fim\\", "estrutura"),
        ("Frase inteira. " * 3_000 + "resto sem f", "aberto"), ("null" + " " * 500, "vazio"),
        ("O hospital é ci", "aberto"), ("Avaliado pelo Dr.", "aberto"), ("uma, duas,", "aberto"), ("Assinou Ana C.", "aberto"),
    ],
)
def test_states(text, want):
    assert truncation.state(text)[0] == want


def test_last_lines_are_compared_whole(spark):
    """Two long last lines that differ before their last 120 characters only."""
    end = " e assim por diante" * 20
    rows = [(i, f"Texto {'x' * i}\nA{end}") for i in range(20)] + [(50, f"Texto\nB{end}")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit("m").alias("g"), truncation.ending("t").alias("s"))
    assert [r.id for r in truncation.cut(df, ["g"]).where("cortado").collect()] == [50]


@pytest.mark.parametrize("n, cut", [(2, True), (3, False), (40, False)])
def test_a_baseline_grows_with_its_evidence(spark, n, cut):
    rows = [(i, f"Texto próprio e longo {'x' * i}\nSem mais nada a dizer") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit("m").alias("g"), truncation.ending("t").alias("s"))
    assert {r.cortado for r in truncation.cut(df, ["g"]).collect()} == {cut}


def test_natural_endings_are_no_cut(spark):
    rows = [(i, "Nada mais consta") for i in range(30)] + [(100 + i, f"Fim número {i}.") for i in range(100)] + [(300, "O paciente foi ent"), (301, "- nomes: 2"), (302, None), (303, " ")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit("m").alias("g"), truncation.ending("t").alias("s"))
    assert [r.id for r in truncation.cut(df, ["g"]).where("cortado").collect()] == [300]
    assert truncation.cut(df.limit(0), ["g"]).count() == 0


def test_copies_of_a_cut_text_are_still_cut(spark):
    rows = [(i, "Segue o resultado da an") for i in range(40)] + [(100 + i, f"Fim número {i}.") for i in range(60)] + [(200 + i, f"Texto {'x' * i}\nNada mais consta") for i in range(10)]
    rows += [(300 + i, f"Lista {'y' * i}\n- dúvidas: nenhuma") for i in range(12)] + [(400, "- dúvidas: nenh"), (401, "- idade: 5")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit("m").alias("g"), truncation.ending("t").alias("s"))
    assert {r.id for r in truncation.cut(df, ["g"]).where("cortado").collect()} == {*range(40), 400}


def test_natural_endings_of_pairs_by_maker(spark):
    rows = [("s", i, "p", f"Texto {'x' * i}\nNada mais consta") for i in range(20)] + [("s", 50, "p", "Outro texto.\nNada mais consta")]
    df = spark.createDataFrame(rows, "source string, id long, prompt string, answer string")
    makers = spark.createDataFrame([("s", r[1], "a" if r[1] < 50 else "b") for r in rows], "source string, id long, maker string")
    assert [(r.id, r.defeito) for r in pairs.defective(df, makers=makers).collect()] == [(50, "truncada")]


NOTE = "Paciente de 54 anos, carteiro, procura o serviço por tosse produtiva iniciada ontem. Nega febre e nega dor torácica ao subir a escada."


@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("p", None, "vazia"), ("p", "```\n\n```", "vazia"), ("p", '{"map_nomes": [], "map_outros": []}', None),
        ("p", "Desculpe, mas não posso ajudar com a extração de dados pessoais.", "recusa"), ("p", "I cannot comply with this request.", "recusa"), (None, "Lo siento, no puedo ayudar con eso.", "recusa"),
        ('{"map_nomes": []}', '{"map_nomes": []}\nNão posso confirmar os termos duvidosos sem mais contexto.', None),
        ("Leia. " + NOTE, NOTE.upper(), "copia"), ("Leia. " + NOTE, "> " + NOTE.replace(" ", "  ").replace("ontem", "hoje"), "copia"),
        ("Leia. " + NOTE, "O texto não contém dados pessoais além dos marcadores.", None), ("Olá, tudo bem?", "olá tudo bem", "copia"), ("Qual o nome? " + NOTE, "tosse produtiva", None),
        ("Leia.\n\n" + NOTE, '{"map_outros": ["' + NOTE + '"]}', "copia"), ("Leia.\n\n" + NOTE, '{"map_outros": ["54 anos", "carteiro"]}', None),
        ("p", "After reading the note I found these identifiers: Ana Lima. The remaining words are medical terms.", "outro_idioma"),
        ("p", "El texto contiene estos identificadores que deben ocultarse: Ana Lima. No hay más elementos en el registro.", "outro_idioma"),
        ("p", "根据病历内容,我找到了以下个人信息:Ana。", "outro_idioma"), ("p", '{"names_of_people": ["Ana"], "explanation": "These strings look like people, so they must be removed from the note."}', "outro_idioma"),
        ("p", '{"map_outros": ["the patient and the nurse were in the room"]}', None), ("p", "Aparecem no texto os nomes Ana Lima, conforme a nota.", None),
    ],
)
def test_defects(prompt, answer, want):
    assert pairs.defect(prompt, answer, 0.3)[0] == want


LONG = "O pedido trata de uma nota clínica escrita pela equipe da unidade durante o plantão. " * 9


@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("p", LONG + "Por isso, não posso ajudar com a extração.", "recusa"), ("p", "Não posso ajudar com a extração de dados. " + LONG, "recusa"), ("p", LONG + "Por fim: I cannot help with this request.", "recusa"),
        ("p", LONG + "A queixa foi esta.", None), ("Leia. Não consigo fazer força com o braço", LONG + "Não consigo fazer força com o braço.", None), ("p", LONG + "O registro diz “não consigo realizar esforço” e segue.", None),
        ("p", "عذراً، لا أستطيع المساعدة في هذا الطلب.", "recusa"), ("p", "क्षमा करें, मैं इस अनुरोध में मदद नहीं कर सकता।", "recusa"), ("p", "ขออภัย ไม่สามารถช่วยเรื่องนี้ได้", "recusa"), ("p", "Извините, я не могу помочь с этим.", "recusa"), ("p", "죄송합니다. 도와드릴 수 없습니다.", "recusa"),
        ("p", "null" + " " * 900, "vazia"), ("p", "-" * 300 + "\nnull\n" + "-" * 300, "vazia"),
    ],
)
def test_refusals_wherever_they_stand(prompt, answer, want):
    assert pairs.defect(prompt, answer, 0.3)[0] == want


def test_defective_pairs_as_rows(spark):
    rows = [("t", 1, "p", "O nome é cit"), ("t", 2, "p", None), ("t", 3, None, "Tudo certo."), ("t", 4, "p", '{"map_nomes": ["A')]
    got = {(r.id, r.defeito) for r in pairs.defective(spark.createDataFrame(rows, "source string, id long, prompt string, answer string")).collect()}
    assert got == {(1, "truncada"), (2, "vazia"), (4, "truncada")}
    assert pairs.defective(spark.createDataFrame([], "source string, id long, prompt string, answer string")).count() == 0


# --- 4: lines ---


def test_excess_lines_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        src = rng.choice(["A", "A", "B", None])
        lines = [f"texto próprio {rng.choice('abcdefgh')} do caso {''.join(rng.choice('abcdefghijklmnop') for _ in range(8))}" for _ in range(4)]
        if rng.random() < 0.3:
            lines.insert(0, f"Aviso  geral nº {i}")  # in every source
        if src == "A" and rng.random() < 0.2:
            lines.append("SÓ DA UNIDADE A")
        if rng.random() < 0.02:
            lines.append("rara mas repetida")
        lines += ["", "12/12"]
        rows.append((i, src, None if i % 50 == 0 else "\n".join(lines)))
    df = spark.createDataFrame(rows, "id long, src string, t string").withColumn("key", F.lit(0))
    got = {(r.id, r.linha) for r in site_lines.excess_places(df, "id", "t", "src").collect()}
    import re

    key = lambda x: re.sub(r"[\s\d]", "", x.lower()) if re.search(r"[^\W\d_]", x) else None
    total, seen = {}, {}
    for i, s, t in rows:
        total[s] = total.get(s, 0) + 1
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            seen[s, k] = seen.get((s, k), 0) + 1
    big = {x for x, n in seen.items() if n >= 10 and n >= 0.05 * total[x[0]]}
    want = {(i, n) for i, s, t in rows if t for n, x in enumerate(t.split("\n")) if (s, key(x)) in big}
    assert got == want and want
    joined = site_lines.excess_places(df, "id", "t", "src", broadcast_lines=0)  # too many lines for a broadcast
    assert {(r.id, r.linha) for r in joined.collect()} == got
    clean = {r.id: r.texto for r in site_lines.without_excess(df, "id", "t", "src").collect()}
    assert clean == {r.id: r.texto for r in site_lines.without_excess(df, "id", "t", "src", broadcast_lines=0).collect()}
    for i, s, t in rows:
        assert clean[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want))


def test_the_ratio_decides(spark):
    """Two lines in the same share of A's records: one stands elsewhere as often, the other nowhere."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        src = "ABC"[i % 3]
        lines = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3)]
        if rng.random() < 0.3:
            lines.append("linha de todos")
        if src == "A" and rng.random() < 0.3:
            lines.append("linha só de A")
        if rng.random() < (0.2 if src == "B" else 0.17):  # the difference is chance
            lines.append("quase igual")
        rows.append((i, src, "\n".join(lines)))
    df = spark.createDataFrame(rows, "id long, src string, t string")
    own = {(r.src, r.key) for r in site_lines.excess_lines(df, "id", "t", "src", against="line").collect()}
    assert own == {("A", "linhasódea")}
    thresholds = {(r.src, r.key) for r in site_lines.excess_lines(df, "id", "t", "src").collect()}
    assert len(thresholds) == 7  # what 5 % and 10 records alone would give
    # forms: every record has the same eight lines out of ten, none is more frequent than lines are
    forms = [(i, "ABC"[i % 3], "\n".join(rng.sample([f"campo {x}" for x in "abcdefghij"], 8))) for i in range(300)]
    assert site_lines.excess_lines(spark.createDataFrame(forms, df.schema), "id", "t", "src").count() == 0


def test_excess_lines_of_nothing(spark):
    df = spark.createDataFrame([], "id long, src string, t string")
    assert site_lines.excess_places(df, "id", "t", "src").count() == 0 and site_lines.without_excess(df, "id", "t", "src").count() == 0
    one = spark.createDataFrame([(i, "A", "mesma linha aqui") for i in range(20)], "id long, src string, t string")
    assert site_lines.excess_places(one, "id", "t", "src").count() == 20


# --- 5: personal data ---

KNOWN = personal.Gazetteer({"ana", "rosa", "luzia", "clara", "severino"}, {"vidando", "fisares", "gudamo"}, {"trombeta", "quirelia"})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Paciente Luzia, cpf 211.739.699.63, residente na Avenida Doutor Broveira, 1955-A, bairro.", [("NAME", "Luzia"), ("IDNUM", "211.739.699.63"), ("ADDRESS", "Avenida Doutor Broveira, 1955-A")]),
        ("Digitado por Severino Vidando\nAlta.", [("NAME", "Severino Vidando")]),
        ("Ligar para (036) 91480 9640 ou escrever a ana.b+x@caixa.test quando sair.", [("PHONE", "(036) 91480 9640"), ("EMAIL", "ana.b+x@caixa.test")]),
        ("correo ana-b[arroba]clinica.test. y tel", [("EMAIL", "ana-b[arroba]clinica.test")]),
        ("邮箱ana (at) posto.invalid。联系电话76 93639-0833,", [("EMAIL", "ana (at) posto.invalid"), ("PHONE", "76 93639-0833")]),
        ("Dra. Gudamo assume. El Dr. Fartares indicó reposo.", [("NAME", "Gudamo"), ("NAME", "Fartares")]),
        ("Nota fiscal 55087447975 anexada, série 846.275.245, ramal 4504.", []),
        ("Novo RG nº 07986669 e CNS 782 4279 4355 5803; pasaporte QX5585793 y", [("IDNUM", "07986669"), ("IDNUM", "782 4279 4355 5803"), ("IDNUM", "QX5585793")]),
        ("Contato com Ana C. de Fisares, moradora da R. Padre Quomino, s/n.", [("NAME", "Ana C. de Fisares"), ("ADDRESS", "R. Padre Quomino, s/n")]),
        ("Encaminhada à Av. central do bairro em 13/01/2020.", []),
        ("", []), (None, []),
    ],
)
def test_candidates(text, want):
    """The spans that the first beliefs alone accept, before anything is learned."""
    def held(k, votes):
        return sum(v * np.log(r / (1 - r)) for v, r in zip(votes, personal.LABELERS[k].values(), strict=True)) > 0

    got = [(k, text[s:e]) for k, s, e, votes, _ in personal.candidates(text, KNOWN) if held(k, votes)]
    assert sorted(got) == sorted(want)


def test_lists_vote_and_drop_nothing():
    """What the lists speak against is still a candidate."""
    got = {(k, t[s:e]) for t in ("Nota fiscal 55087447975 anexada.", "Visitou o estande do Outubro Rosa.", "Evolução registrada por Enf. Ana.", "Perfil @saude_bairro na Av. central.") for k, s, e, *_ in personal.candidates(t, KNOWN)}
    assert {("PHONE", "55087447975"), ("NAME", "Rosa"), ("NAME", "Enf"), ("NAME", "Ana"), ("EMAIL", "@saude_bairro"), ("ADDRESS", "Av. central")} <= got


def test_many_spans_in_one_text():
    text = "Paciente Ana Vidando, fone (36) 91480-9640, CPF 211.739.699-63. " * 4_000
    assert len(personal.candidates(text, KNOWN)) == 12_000


def test_negative_votes_win_and_redaction(spark):
    known = spark.createDataFrame([("nome", "Ana Lima"), ("nome", "Rosa Fisares"), ("endereco", "Vila Trombeta"), ("nome", None)], "tipo string, texto_original string")
    rows = [("t", i, f"Visitou o estande do Outubro Rosa. Paciente Ana Lima, CPF 211.739.699-{i:02d}, contato (36) 91480-96{i:02d}.") for i in range(40)] + [("t", 99, None), ("t", 98, "")]
    df = spark.createDataFrame(rows, "src string, id long, text string")
    found = personal.find(df, known).where("id = 3").collect()
    assert sorted((r.tipo, rows[3][2][r.inicio : r.fim]) for r in found) == [("IDNUM", "211.739.699-03"), ("NAME", "Ana Lima"), ("PHONE", "(36) 91480-9603")]
    out = {r.id: r.texto for r in personal.redact(df, known).collect()}
    assert out[3] == "Visitou o estande do Outubro Rosa. Paciente [NAME], CPF [IDNUM], contato [PHONE]." and out[99] is None and out[98] == ""
    assert personal.find(df.limit(0), known).count() == 0


def test_reliabilities_learn_from_agreement():
    counts = {(1, 1, 0, 0, 0, 0): 900.0, (1, -1, 0, 0, 0, 0): 5.0, (0, -1, 0, 0, 0, -1): 400.0, (0, 1, 0, 0, 0, 0): 50.0}
    p, right = personal.reliabilities(counts, [0.95, 0.9, 0.85, 0.8, 0.85, 0.98])
    q = personal.classifier({(v, ""): n for v, n in counts.items()}, p)
    assert p[1, 1, 0, 0, 0, 0] > 0.9 > 0.2 > p[0, -1, 0, 0, 0, -1] and max(abs(p[k] - q[k, ""]) for k in counts) < 0.25
    assert right[0] > 0.9 and right[1] > 0.9


def test_a_labeler_that_is_mostly_wrong_is_found_out():
    """Five labelers right in nine of ten spans, one in one of ten, all believed alike at first."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.5
    hit = rng.random((20_000, 6)) < np.array([0.9] * 5 + [0.1])
    votes = np.where(hit == truth[:, None], 1, -1)
    counts: dict = {}
    for v in map(tuple, votes.tolist()):
        counts[v] = counts.get(v, 0.0) + 1
    counts[0, 0, 0, 0, 0, 1] = 1.0
    post, right = personal.reliabilities(counts, [0.85] * 6)
    assert all(abs(r - 0.9) < 0.02 for r in right[:5]) and abs(right[5] - 0.1) < 0.02
    assert post[0, 0, 0, 0, 0, 1] < 0.2
    assert np.mean([(post[v] >= 0.5) == t for v, t in zip(map(tuple, votes.tolist()), truth)]) > 0.98
    few, _ = personal.reliabilities({v: n / 10_000 for v, n in counts.items()}, [0.85] * 6)
    assert few[0, 0, 0, 0, 0, 1] > 0.5  # with hardly a row, the beliefs stand


# --- 6: repetition ---


def test_measure():
    assert repetition.measure(None) is None and repetition.measure(" \n") is None
    s = "O valor medido não identifica ninguém aqui. "
    share = lambda t: repetition.measure(t)[-1]
    assert share(s) == 0.0
    assert share(s * 4) > 0.7
    assert share("Passo 1: " + s.strip() + "\nTentativa 2: " + s.strip().upper() + "\n3) " + s.strip()) > 0.5
    assert share("início normal do texto " + "sim " * 100) > 0.8
    assert share("início normal do texto " + "A" * 200) > 0.8
    assert share("início normal do texto " + "-=" * 100) > 0.8
    assert len(repetition.measure("a b c d " * 20_000)) == len(repetition.FEATURES) + 1


def _plain_texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(" ".join(_words(rng, 9)) + f" n{rng.randint(0, 9999)}." for _ in range(8)) for _ in range(n)]


def test_decision_list_on_held_out_rows():
    """Recall and precision of the list alone, on planted texts it hasn't seen, exact share left out."""
    assert "coberto" not in repetition.FEATURES
    rules = repetition.learn(*repetition.labelled(_plain_texts(4, 200), 0.4, seed=7))
    x, y = repetition.labelled(_plain_texts(5, 200), 0.4, seed=8)
    hit = np.zeros(len(y), dtype=bool)
    for r in rules:
        hit |= repetition._holds(x, r)
    assert (hit & (y == 1)).sum() >= 0.97 * (y == 1).sum() and (hit & (y == 1)).sum() >= 0.93 * hit.sum() and 1 <= len(rules) <= 10


def test_repetitive_rows(spark):
    s = "O valor medido não identifica ninguém aqui. "
    rows = [("a", 1, s * 5), ("a", 2, "Texto normal com palavras diferentes, sem nada que se repita de novo."), ("a", 3, None), ("a", 4, "")]
    df = spark.createDataFrame(rows, "src string, id long, text string")
    assert [r.id for r in repetition.repetitive(df).where("repetitivo").collect()] == [1]
    assert repetition.repetitive(df.limit(0)).count() == 0


def test_the_list_decides_which_texts_are_repetitive(spark, monkeypatch):
    """A text over the limit that no rule accepts isn't taken."""
    df = spark.createDataFrame([("a", 1, "O valor medido não identifica ninguém aqui. " * 5)], "src string, id long, text string")
    monkeypatch.setattr(repetition, "learned", lambda *a, **k: [[(repetition.FEATURES.index("corrida"), True, 2.0)]])
    r = repetition.repetitive(df).first()
    assert r.coberto > 0.7 and r.regra == 0 and not r.repetitivo


# --- 8: tokenizer ---


def _reference_ids(texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoding_equals_the_tokenizer(spark):
    rng = random.Random(6)
    texts = ["Hello world", "", None, "  ", "não é\n\n fim  ", "<|endoftext|> <s>", "体温は36.1度、脈拍", "don't I'll 1234567", "😀👩‍👩‍👧 x", "a" * 5_000, "รักษา" * 200, "".join(rng.choice("abcdeé中") for _ in range(1200)), "รักษา", " x​", "é"]
    texts += ["".join(rng.choice(" abcdefé'ñ1239\n\t-_=中あ😀") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    enc = bpe.encode(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert [got[i] for i in range(len(texts))] == _reference_ids(texts)
    back = {r.doc_id: r.texto for r in bpe.decode(enc, "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    n = {r.doc_id: r.tokens for r in bpe.token_counts(df, "doc_id", "text").collect()}
    assert n == {i: len(x) for i, x in got.items()}
    for few in (0, 20):  # most words are below the cut: they are joined, not looked up
        assert {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text", frequent=few).collect()} == got
        assert {r.doc_id: r.tokens for r in bpe.token_counts(df, "doc_id", "text", frequent=few).collect()} == n
    twice = bpe.with_ids(df.unionAll(df), "text", "lista", frequent=20).collect()
    assert len(twice) == 2 * len(texts) and all(r.lista == got[r.doc_id] and r.ids == 1 for r in twice)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


# --- 9: mixing ---


def _leaf(s, size, w, r, d="d", la="l"):
    return {"source": s, "domain": d, "lang": la, "size": size, "weight": w, "repeats": r}


def test_budgets():
    exact = mixing.budgets([_leaf("a", 100, 0.5, 1), _leaf("b", 1000, 0.5, 1)])
    assert [x["budget"] for x in exact] == [100, 100]
    short = mixing.budgets([_leaf("a", 10, 0.5, 2), _leaf("b", 1000, 0.1, 1), _leaf("c", 1000, 0.4, 1, "x")], 200)
    assert [round(x["budget"]) for x in short] == [20, 100, 80]  # the sibling takes it all
    cells = mixing.budgets([_leaf("a", 10, 0.3, 1), _leaf("a", 1000, 0.2, 1, "x"), _leaf("b", 1000, 0.5, 1)], 200)
    assert [round(x["budget"]) for x in cells] == [10, 90, 100]  # the source's other leaf before the sibling
    up = mixing.budgets([_leaf("a", 10, 0.5, 1), _leaf("b", 30, 0.1, 1), _leaf("c", 1000, 0.2, 1, "d", "m"), _leaf("e", 1000, 0.2, 1, "x")], 200)
    assert [round(x["budget"]) for x in up] == [10, 30, 120, 40]  # the sibling's room, then the domain's
    full = mixing.budgets([_leaf("a", 10, 0.5, 1), _leaf("b", 10, 0.5, 1)], 200)
    assert [x["budget"] for x in full] == [10, 10]
    assert mixing.budgets([_leaf("a", 10, None, None)])[0]["budget"] == 0


def test_mix_reaches_shares_and_repeats(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice("aaabbc"), rng.choice(["pt", "PT", "es", None]), rng.choice(["d", "e", None]), rng.randint(5, 15)) for i in range(3000)] + [(9000, None, "pt", "d", 5), (9001, "z", "pt", "d", 5), (9002, "a", None, None, 0)]
    df = spark.createDataFrame(docs, "id long, source string, lang string, domain string, tokens int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.5, 4), ("vazia", 0.0, 1), ("sem", 0.1, 2)], "source string, target_share double, max_repeats int")
    used, leaves = mixing.mix(df, targets)
    rows = used.collect()
    cap = {"a": 1, "b": 3, "c": 4}
    assert all(1 <= r.uses <= cap[r.source] for r in rows)
    rep = {r.source: r for r in mixing.shares(used, leaves).collect()}
    total = sum(r.tokens for r in rep.values())
    for s, w in (("a", 0.2), ("b", 0.3), ("c", 0.5)):
        assert abs(rep[s].tokens - rep[s].orcamento) <= 8 and abs(rep[s].tokens / total - w) < 0.01
    assert rep["a"].folhas == 9
    per = {}
    for r in rows:
        k = r.source, r.domain, r.lang
        per[k] = per.get(k, 0) + r.tokens * r.uses
    for x in leaves.where("size > 0").collect():  # each leaf gives its part; the largest evens out
        assert abs(per[x.source, x.domain, x.lang] - x.budget) <= 9 * 8
    assert rep["vazia"].tokens == rep["sem"].tokens == 0 and set(rep) == {"a", "b", "c", "vazia", "sem"}
    again = sorted((r.id, r.uses) for r in mixing.mix(df.repartition(7), targets)[0].collect())
    assert again == sorted((r.id, r.uses) for r in rows)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


# --- 10: sentences ---


@pytest.mark.parametrize(
    "text, want",
    [
        ("Um. Dois! Três?", ["Um.", "Dois!", "Três?"]),
        ("O Dr. Silva e a Sra. Ana vieram às 9h30. Alta.", ["O Dr. Silva e a Sra. Ana vieram às 9h30.", "Alta."]),
        ("Usar 10,5 mg, máx. 10x/d., até o dia 70. Volta.", ["Usar 10,5 mg, máx. 10x/d., até o dia 70.", "Volta."]),
        ("Fim do caso.Paciente bem.", ["Fim do caso.", "Paciente bem."]),
        ("Título\nlinha que segue\n- item um\n- item dois", ["Título\nlinha que segue", "- item um", "- item dois"]),
        ("1. Primeiro item\n2. Segundo item", ["1. Primeiro item", "2. Segundo item"]),
        ("Segundo a tia, “ele caiu. Depois levantou” e saiu. Fim.", ["Segundo a tia, “ele caiu. Depois levantou” e saiu.", "Fim."]),
        ('Ela disse: "Dói muito. Não durmo." Hoje melhor.', ['Ela disse: "Dói muito. Não durmo."', "Hoje melhor."]),
        ("Ficou em casa... e voltou. Esperou... Depois saiu.", ["Ficou em casa... e voltou.", "Esperou...", "Depois saiu."]),
        ("家属说:“他昨晚恶心。今天好多了。”头痛明显减轻!可能……需要观察。", ["家属说:“他昨晚恶心。今天好多了。”", "头痛明显减轻!", "可能……需要观察。"]),
        ("家族は「不眠です。眠れません。」と話した。体温は36.1度。", ["家族は「不眠です。眠れません。」と話した。", "体温は36.1度。"]),
        ("डॉ. ने कहा। ठीक है।", ["डॉ. ने कहा।", "ठीक है।"]),
        ("أوصى د. المناوب بمتابعة. هل تكرر سعال؟", ["أوصى د. المناوب بمتابعة.", "هل تكرر سعال؟"]),
        ("ปวดท้อง 12 วัน ญาติแจ้งว่ามีไข้ ดีขึ้นหรือไม่?", ["ปวดท้อง 12 วัน ญาติแจ้งว่ามีไข้", "ดีขึ้นหรือไม่?"]),
        ("Escreva a ana.b@mail.example. Obrigado.", ["Escreva a ana.b@mail.example.", "Obrigado."]),
        ("  \n", []), ("", []), (None, []), ("...", ["..."]),
    ],
)
def test_units(text, want):
    if text and "12 วัน" in text:
        want = ["ปวดท้อง 12 วัน", "ญาติแจ้งว่ามีไข้", "ดีขึ้นหรือไม่?"]
    assert [text[s:e] for s, e in sentences.units(text)] == want


def test_quotations_of_any_length_and_long_words():
    long = "ele caiu. Depois levantou. " * 40
    for text in (f"Segundo a tia, “{long}e foi” e saiu. Fim.", f"Segundo a tia ({long}e foi) e saiu. Fim."):
        assert [text[s:e] for s, e in sentences.units(text)] == [text[:-5], "Fim."]
    text = "abc." * 50_000
    assert sentences.units(text) and sentences.units("(" * 50_000 + ". A“" * 50_000)


def test_the_document_decides_before_the_lists():
    silent = "Veio o Sr. Alta e saiu."
    assert len(sentences.units(silent)) == 1
    text = "Tudo seg. Depois veio. Ficou seg. Hoje não. E depois, hoje, nada. Outra seg. Hoje sim."
    assert "seg" in sentences.SHORTENED and sentences._short("seg", sentences.stop_counts(""), sentences.Known())
    assert [text[s:e] for s, e in sentences.units(text)][:3] == ["Tudo seg.", "Depois veio.", "Ficou seg."]
    corpus = sentences.Known(ends={"seg"})
    assert not sentences._short("seg", sentences.stop_counts(""), corpus)


def test_rare_words_reach_their_documents(spark):
    """The same units whether all words are sent to every task or none is."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["usar xpto. de novo.", "Usar xpto. Ana foi.", "vide qrs. 5 dias.", "Casa bela. Rua nova.", "casa e rua."]) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    words = sentences.corpus_words(df, "text")
    assert words.count() >= 2 and sentences._listed(words, 0)[1] is not None
    get = lambda n: sorted(map(tuple, sentences.sentence_units(df, "doc_id", "text", listed=n).collect()))
    assert get(0) == get(50_000)


def test_units_cover_every_text(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["a", "B", ". ", "! ", "\n", " ", '"', "(", ")", "…", "。", "Dr. ", "9", "\r\n"]) for _ in range(80))) for i in range(150)] + [(900, None), (901, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fim", F.lit(1))
    got = sentences.sentence_units(df, "doc_id", "text", with_text=True).collect()
    for i, t in rows:
        mine = sorted((r.ordem, r.inicio, r.fim, r.texto) for r in got if r.doc_id == i)
        at = 0
        for k, (o, s, e, x) in enumerate(mine):
            assert o == k and s >= at and x == t[s:e] == x.strip() and not t[at:s].strip()
            at = e
        assert t is None or not t[at:].strip()
    assert sentences.sentence_units(df.limit(0), "doc_id", "text").count() == 0
