"""Calls to an outside extractor (a model) with retry, as rows.

A provider is a function ``(prompt, options) -> dict`` with the keys ``resposta``, ``raciocinio``,
``status_erro``, ``loop_inicio`` and ``metricas`` (any may be missing). It is sent to the
tasks, so it must be picklable; ``Scripted`` answers from a table and is used in tests.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velatura.config import LoopSettings, Settings
from velatura.functions.text import drop_leaked_tags

ANSWER = "struct<map_nomes:array<string>,map_enderecos:array<string>,map_outros:array<string>,map_idades:array<string>,map_profissoes:array<string>,duvidas_pendentes:array<string>>"
ATTEMPT = "chave string, tentativa int, prompt string, resposta string, raciocinio string, status_erro string, houve_falha boolean, final boolean"


class Scripted:
    """Answers by (prompt key, attempt); the last one of a key repeats."""

    def __init__(self, answers: dict[str, list[dict]]):
        self.answers = answers

    def __call__(self, prompt: str, options: dict) -> dict:
        mine = self.answers.get(options["chave"], [{}])
        return mine[min(options["tentativa"], len(mine)) - 1]


class Streamed:
    """A provider that reads a model's answer chunk by chunk and stops it when its reasoning loops.

    ``chat(prompt, options)`` yields dicts: ``thinking`` and ``content`` are pieces of text, ``done``
    ends the stream with ``done_reason`` and the counts and nanoseconds of the call. Without
    reasoning of its own, ``<think>`` marks in the content are taken for it. A stream that is stopped
    has partial metrics: a chunk counts as one token, and the time is the time until then.
    """

    def __init__(self, chat: Callable, models: tuple[str, ...] = (), settings: LoopSettings = LoopSettings(), clock: Callable[[], float] = time.monotonic):
        self.chat, self.models, self.settings, self.clock = chat, models, settings, clock

    def has_model(self, name: str) -> bool:
        """Whether the model is there; a provider's name may stand before it, with a colon."""
        return name in self.models or name.partition(":")[2] in self.models

    def __call__(self, prompt: str, options: dict) -> dict:
        from velatura.streaming.loops import LoopDetector

        loop, thinking, content, chunks = LoopDetector(self.settings), [], [], 0
        began = self.clock()
        out: dict = {"status_erro": None, "loop_inicio": None, "metricas": {}}
        try:
            for part in self.chat(prompt, options):
                chunks += 1
                thinking.append(part.get("thinking") or "")
                content.append(part.get("content") or "")
                if thinking[-1] and (hit := loop.feed(thinking[-1])):
                    out |= {"status_erro": f"loop:{hit}", "loop_inicio": loop.start, "metricas": self._partial(chunks, began)}
                    break
                if part.get("done"):
                    out["metricas"] = _seconds(part)
                    if part.get("done_reason") not in (None, "stop"):
                        out["status_erro"] = "erro_stop_reason"
        except TimeoutError:
            out |= {"status_erro": "timeout", "metricas": self._partial(chunks, began)}
        except Exception as e:  # noqa: BLE001 - whatever the model's client raises is an answer too
            out |= {"status_erro": f"erro: {e}", "metricas": self._partial(chunks, began)}
        reasoning, answer = "".join(thinking), "".join(content)
        inside = None if reasoning else re.search(r"<think>(.*?)</think>\s*(.*)", answer, re.S)
        if inside:
            reasoning, answer = inside.groups()
        return out | {"raciocinio": reasoning, "resposta": answer}

    def _partial(self, chunks: int, began: float) -> dict:
        sec = self.clock() - began
        return {"eval_count": chunks, "total_duration_sec": sec, "eval_tokens_per_second": chunks / sec if sec > 0 else None}


def _seconds(done: dict) -> dict:
    """The metrics of a finished call, nanoseconds as seconds."""
    out = {k: done.get(k) for k in ("prompt_eval_count", "eval_count")}
    for k in ("total_duration", "load_duration", "prompt_eval_duration", "eval_duration"):
        out[f"{k}_sec"] = done[k] / 1e9 if done.get(k) is not None else None
    sec = out["eval_duration_sec"]
    out["eval_tokens_per_second"] = out["eval_count"] / sec if sec and out["eval_count"] is not None else None
    return out


def split_thinking(content: Column) -> tuple[Column, Column]:
    """(reasoning, answer) of a text with ``<think>`` marks; without them all is the answer."""
    both = r"(?s)<think>(.*?)</think>\s*(.*)"
    inside = content.rlike(both)
    return F.when(inside, F.regexp_extract(content, both, 1)), F.when(inside, F.regexp_extract(content, both, 2)).otherwise(content)


def call_metrics(df: DataFrame) -> DataFrame:
    """Seconds from nanosecond columns ``*_duration``, and tokens a second; division is guarded."""
    out = df
    for c in ("total_duration", "load_duration", "prompt_eval_duration", "eval_duration"):
        out = out.withColumn(f"{c}_sec", F.col(c) / 1e9)
    return out.withColumn("eval_tokens_per_second", F.when(F.col("eval_duration") > 0, F.col("eval_count") / (F.col("eval_duration") / 1e9)))


def stop_status(done_reason: Column, error: Column) -> Column:
    """Error status of a call: timeout, erro, erro_stop_reason or null."""
    return F.when(F.lower(error).contains("timeout"), "timeout").when(error.isNotNull(), "erro").when(done_reason.isNotNull() & (done_reason != "stop"), "erro_stop_reason")


def attempts(prompts: DataFrame, provider: Callable, settings: Settings = Settings()) -> DataFrame:
    """Every attempt of each (chave, prompt); ``final`` marks the one that counts.

    An attempt succeeds with no error and an answer that isn't blank. After a loop, the
    reasoning up to its start goes into the next prompt and thinking is turned off; with
    ``inject_reasoning`` off, such a call is not repeated and its answer is an empty detection.
    When no attempt succeeds, the last one has ``houve_falha``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for key, prompt in zip(b["chave"], b["prompt"]) for r in _tries(key, prompt, provider, settings)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ATTEMPT.split(", ")])

    return prompts.select("chave", "prompt").mapInPandas(run, ATTEMPT)


def _tries(key: str, prompt: str, provider: Callable, s: Settings) -> list[tuple]:
    rows, text, think = [], prompt or "", True
    for k in range(1, s.attempts + 1):
        options = {"chave": key, "tentativa": k, "pensar": think, "num_ctx": s.num_ctx, "num_predict": s.num_predict if think else s.num_ctx - 68, "temperatura": s.temperature}
        got = provider(text, options)
        answer, reasoning, error = got.get("resposta") or "", got.get("raciocinio") or "", got.get("status_erro")
        ok = error is None and bool(answer.strip())
        if not ok and error and not s.inject_reasoning:
            rows.append((key, k, text, "{}", reasoning, error, True, True))
            return rows
        last = ok or k == s.attempts
        rows.append((key, k, text, answer, reasoning, error, not ok and (error is not None or last), last))
        if ok:
            break
        if error and reasoning:
            at = got.get("loop_inicio")
            text = f"{prompt}\n\nA tentativa anterior parou. Continue de:\n{reasoning[:at] if at else reasoning}"
            think = False
    return rows


def parsed(answer: Column) -> Column:
    """The lists of a JSON answer, fences removed; null if it isn't an object. Missing lists are empty."""
    body = F.regexp_replace(answer, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    st = F.from_json(body, ANSWER)
    empty = F.array().cast("array<string>")
    names = ["map_nomes", "map_enderecos", "map_outros", "map_idades", "map_profissoes", "duvidas_pendentes"]
    return F.when(F.ltrim(body).startswith("{") & st.isNotNull(), F.struct(*[F.coalesce(st[n], empty).alias(n) for n in names]))


def answer_terms(df: DataFrame, answer_col: str, context_col: str, *keep: str) -> DataFrame:
    """(keep..., tipo, termo, pos): terms of the answers, leaked tags left out; ages and professions are info."""
    kinds = {"map_nomes": "nome", "map_enderecos": "endereco", "map_outros": "info", "map_idades": "info", "map_profissoes": "info", "duvidas_pendentes": "revisao"}
    p = parsed(F.col(answer_col))
    lists = F.array(*[F.struct(F.lit(k).alias("tipo"), F.lit(i).alias("lista"), drop_leaked_tags(p[n], F.col(context_col)).alias("termos")) for i, (n, k) in enumerate(kinds.items())])
    rows = df.select(*keep, F.inline(lists))
    return rows.select(*keep, "tipo", "lista", F.posexplode("termos").alias("pos", "termo"))


def two_rounds(records: DataFrame, provider: Callable, settings: Settings = Settings()) -> DataFrame:
    """(chave, rodada, + attempt columns): a second round, on the raw text, where the first left doubts or bad JSON.

    ``records`` has chave, prompt and prompt_bruto.
    """
    first = attempts(records, provider, settings).withColumn("rodada", F.lit(1))
    p = parsed(F.col("resposta"))
    doubtful = first.where("final").where(p.isNull() | (F.size(p["duvidas_pendentes"]) > 0)).select("chave")
    again = records.join(doubtful, "chave", "left_semi").select("chave", F.col("prompt_bruto").alias("prompt"))
    second = attempts(again, provider, settings).withColumn("rodada", F.lit(2))
    return first.unionByName(second)


def review_kind(answer: Column, error: Column) -> Column:
    """Final kind of a term under review: null to drop it."""
    kind = F.lower(F.coalesce(F.get_json_object(F.regexp_replace(answer, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), "$.classificacao"), F.lit("outros")))
    return F.when(error.isNotNull(), "unknown").when(kind == "seguro", F.lit(None)).when(kind.isin("nome", "endereco"), kind).when(kind == "outros", "info").otherwise("unknown")
