"""Functions on chat requests and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions.entries import strip_header
from gistmill.functions.text import strip
from gistmill.schemas import CHAT_RESPONSE


def chat_request(relative_path: Column, text: Column, model: str) -> Column:
    """JSON body that asks for the summary of one file."""
    question = F.concat(
        F.lit("Path: "), relative_path, F.lit("\n----- text of the file -----\n"), text, F.lit("\n----- end of the file -----"),
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(fv.SYSTEM_PROMPT)), message("user", question))
        .alias("messages"),
        F.lit(fv.TEMPERATURE).alias("temperature"),
        F.lit(fv.MAX_ANSWER_TOKENS).alias("max_tokens"),
    ))


def _content(body: Column) -> Column:
    """Text of the first choice; only a JSON string is an answer."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.choices[0].message.content", "variant"))
    text = F.get(F.from_json(body, CHAT_RESPONSE)["choices"], F.lit(0))["message"]["content"]
    return F.when(kind == "STRING", text)


def chat_answer(status_code: Column, body: Column, relative_path: Column) -> Column:
    """Text of the first choice of a successful response; NULL for any other response."""
    answer = _content(body)
    return F.when(status_code == 200, strip_header(strip(answer), relative_path))


def attempt_error(
    status_code: Column, error_kind: Column, body: Column, timeout: float
) -> Column:
    """What went wrong in one attempt; NULL when it brought an answer.

    A transport failure has an ``error_kind`` and its detail in ``body``.
    """
    choices = F.from_json(body, CHAT_RESPONSE)["choices"]
    answer = _content(body)
    detail = F.coalesce(body, F.lit(""))
    return (
        F.when(error_kind == "no_key", F.lit(fv.NO_KEY))
        .when(error_kind == "timeout", F.lit(fv.TIMED_OUT.format(timeout)))
        .when(error_kind == "connection", F.concat(F.lit(fv.CONNECTION_FAILED), detail))
        .when(error_kind == "request", F.concat(F.lit(fv.REQUEST_FAILED), detail))
        .when(error_kind.isNotNull(), F.concat(F.lit(fv.UNEXPECTED), detail))
        .when(F.coalesce(status_code, F.lit(0)) != 200,
              F.concat(F.lit(fv.API_ERROR), F.coalesce(status_code.cast("string"), F.lit("none")),
                       F.lit(": "), detail))
        .when(F.try_parse_json(body).isNull(), F.lit(fv.REQUEST_FAILED + fv.NOT_JSON))
        .when(F.coalesce(F.size(choices), F.lit(0)) < 1, F.lit(fv.NO_CHOICES))
        .when(answer.isNull(), F.lit(fv.NO_TEXT))
    )


def is_failed_text(result: Column) -> Column:
    return F.startswith(result, F.lit(fv.FAILED_TEXT))
