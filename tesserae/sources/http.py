"""A model behind HTTP as column functions: bounded concurrent requests in each task, failures as values."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.models import Models

SAID = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def messages(system: str, user: str, temperature: float, most: int) -> dict:
    """A request body with the two roles."""
    return {"messages": [{"role": "system", "text": system}, {"role": "user", "text": user}], "temperature": temperature, "max_tokens": most}


def first_text(body: dict) -> str:
    """The text of the first alternative of an answer."""
    return body["result"]["alternatives"][0]["message"]["text"]


@dataclass(frozen=True)
class HttpModel:
    """Where a model is and how it is spoken to. ``body`` and ``text`` are top-level functions: they travel to the tasks."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0
    concurrency: int = 4
    body: Callable[[str, str, float, int], dict] = messages
    text: Callable[[dict], str] = first_text

    def __post_init__(self):
        if not self.url.startswith(("http://", "https://")):
            raise ValueError("a model needs an http(s) address")
        if any(not v for v in self.headers.values()):
            raise ValueError("a header without a value: is the key set?")

    def request(self, system: str, user: str, temperature: float, most: int) -> tuple[str | None, str | None]:
        """(text, error) of one request; whatever goes wrong is the error."""
        data = json.dumps(self.body(system, user, temperature, most), ensure_ascii=False).encode()
        sent = urllib.request.Request(self.url, data, {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(sent, timeout=self.timeout) as answer:
                if answer.status != 200:
                    return None, f"HTTP {answer.status}: {answer.read(300).decode('utf-8', 'replace')}"
                return self.text(json.load(answer)), None
        except urllib.error.HTTPError as e:
            return None, f"HTTP {e.code}: {e.read(300).decode('utf-8', 'replace')}"
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:300]

    def said(self, system: Column | str, user: Column, temperature: float = 0.1, most: int = 1200) -> Column:
        """struct(text, error) of a request for each row, at most ``concurrency`` at once in a task; a null ``user`` asks nothing."""
        model = self

        @F.pandas_udf(SAID)
        def ask(systems: pd.Series, users: pd.Series) -> pd.DataFrame:
            def one(pair):
                return (None, None) if pair[1] is None else model.request(pair[0] or "", pair[1], temperature, most)

            with ThreadPoolExecutor(model.concurrency) as pool:
                return pd.DataFrame(list(pool.map(one, zip(systems, users, strict=True))), columns=["text", "error"], dtype=object)

        return ask(F.lit(system) if isinstance(system, str) else system, user)

    def ask(self, rows: DataFrame, system: Column | str, user: Column, temperature: float = 0.1, most: int = 1200) -> DataFrame:
        """``rows`` with text and error of a request each."""
        return rows.withColumn("_said", self.said(system, user, temperature, most)).select("*", "_said.text", "_said.error").drop("_said")

    def models(self, **others) -> Models:
        """All stages that speak to a language model, each with its task; embeddings and scores come from ``others``."""
        def stage(task: str, temperature: float, most: int, *labels: str) -> Callable[..., Column]:
            def call(*values: Column) -> Column:
                parts = [F.concat(F.lit(f"{label}:\n"), v) if label else v for label, v in zip(labels, values, strict=True)]
                return self.said(task, F.concat_ws("\n\n", *parts), temperature, most)["text"]

            return call

        return Models(
            summarise=stage(TASKS["summarise"], 0.1, 350, "ЗАГОЛОВОК", "ТЕКСТ"),
            correct=stage(TASKS["correct"], 0.0, 180, ""),
            variants=stage(TASKS["variants"], 0.15, 300, ""),
            decompose=stage(TASKS["decompose"], 0.1, 220, ""),
            plan=stage(TASKS["plan"], 0.0, 500, "РАЗДЕЛЫ", "ВОПРОС"),
            order=stage(TASKS["order"], 0.0, 120, "ВОПРОС", "ФРАГМЕНТЫ"),
            answer=stage(TASKS["answer"], 0.1, 1200, "КОНТЕКСТ", "ВОПРОС", "ПОДРОБНОСТЬ"),
            compare=stage(TASKS["compare"], 0.1, 1400, "ИЗМЕНЕНИЯ", "ВОПРОС"),
            **others,
        )


TASKS = {
    "summarise": "Перескажи раздел в 3-5 предложениях для поиска: темы, условия, сроки, номера. Ничего не добавляй.",
    "correct": "Верни вопрос одной строкой без опечаток. Смысл, номера, даты и термины не меняй.",
    "variants": 'Дай варианты запроса как JSON {"dense": [до 3 вопросов], "bm25": [до 2 наборов ключевых слов]}. Больше ничего.',
    "decompose": "Раздели вопрос на 2-3 коротких самостоятельных, каждый с новой строки.",
    "plan": 'По списку разделов дай план поиска как JSON {"dense_queries": [до 4], "bm25_queries": [до 4], "section_titles": [до 5 из списка]}. На вопрос не отвечай.',
    "order": "Назови через запятую номера фрагментов, которые лучше всего отвечают на вопрос, лучшие первыми.",
    "answer": "Ответь на вопрос только по контексту, со ссылками на номера в скобках. Нет ответа в контексте - так и скажи.",
    "compare": "Ответь по списку изменений, отдельно добавленное, удалённое и изменённое; при compare_mode не all - только о нём.",
}
