"""Model choice, replies of models, and checks of their configuration. No model is called unless a caller gives one."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from boardlens.functions import validate

ROLES = ("vision", "text", "fast_text")


@dataclass(frozen=True)
class ModelConfig:
    preset: str = "none"
    vision: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    fast_text: tuple[str, ...] = ()
    require_parameters: bool = True

    def signature(self) -> str:
        """What a cache key depends on."""
        return json.dumps([self.preset, self.vision, self.text, self.fast_text])


def distinct(names: list[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for n in names if n))


def read_config(presets: dict[str, ModelConfig], default: str, env: dict[str, str]) -> ModelConfig:
    """A preset with lists and single overrides from settings (an override comes first)."""
    name = env.get("LLM_MODEL_PRESET", "").strip() or default
    if name not in presets:
        raise ValueError(f"unknown model preset {name}; known: {', '.join(presets)}")
    base = presets[name]

    def chosen(role: str, single: str | None) -> tuple[str, ...]:
        listed = [x.strip() for x in env.get(f"LLM_{role.upper()}_MODELS", "").split(",") if x.strip()]
        first = [env[single].strip()] if single and env.get(single, "").strip() else []
        return distinct(first + (listed or list(getattr(base, role))))

    require = validate.read_bool("LLM_PROVIDER_REQUIRE_PARAMETERS", True)
    return ModelConfig(name, chosen("vision", "LLM_VISION_MODEL"), chosen("text", "LLM_TEXT_MODEL"), chosen("fast_text", None), require)


class RateLimited(Exception):
    def __init__(self, retry_after: float | None = None):
        super().__init__("rate limited")
        self.retry_after = retry_after


class Unsupported(Exception):
    """The model does not take this reply format."""


class ModelFailed(Exception):
    """The next model may do better."""


def parse_reply(raw: str, model: str = "", finish: str | None = None) -> object:
    """The JSON of a reply: code fences off, else its outermost braces."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", raw.strip()).strip()
    for text in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
        try:
            return json.loads(text)
        except ValueError:
            continue
    raise ModelFailed(f"{model}: no JSON in the reply" + (" (cut off)" if finish == "length" else ""))


def chat_json(call: Callable[[str, object, str | None], str], models: tuple[str, ...], messages: object, *, schema: bool = True, retries: int = 1, longest_wait: float = 5.0, sleep=time.sleep) -> object:
    """Ask models in turn; each with a schema, then plain JSON, then no format; wait out a rate limit."""
    last: Exception | None = None
    for model in models:
        for form in (("json_schema", "json_object", None) if schema else ("json_object", None)):
            try:
                for turn in range(retries + 1):
                    try:
                        return parse_reply(call(model, messages, form), model)
                    except RateLimited as e:
                        if turn == retries:
                            raise ModelFailed(f"{model}: rate limited") from e
                        sleep(min(longest_wait, e.retry_after if e.retry_after is not None else 2.0**turn))
            except Unsupported as e:
                last = e
                continue
            except ModelFailed as e:
                last = e
            break
    raise ModelFailed(f"no model answered: {last}")


CHALLENGES = (
    ("text_json", "text", "Calculate 17 + 25. Reply with a JSON object with one numeric field, result.", "result", 42),
    ("fast_text_json", "fast_text", "Calculate 9 * 7. Reply with a JSON object with one numeric field, result.", "result", 63),
    ("vision_json", "vision", "Which of red, green, blue, yellow dominates the attached image? Reply with a JSON object with one text field, dominantColor.", "dominantColor", "blue"),
)


def accepts(reply: object, field: str, expected: object) -> bool:
    """Exactly that field, with exactly that value (no number as text, no truth value)."""
    if not isinstance(reply, dict) or list(reply) != [field] or isinstance(reply[field], bool):
        return False
    got = reply[field]
    return got == expected if not isinstance(expected, str) else isinstance(got, str) and got.strip().lower() == expected


def diagnose(spark, config: ModelConfig, call: Callable[[str, object, str | None], str]):
    """(name, ok, detail) of three strict challenges, and whether all passed, as a DataFrame."""
    rows = []
    for name, role, question, field, expected in CHALLENGES:
        try:
            reply = chat_json(call, getattr(config, role), question)
            ok = accepts(reply, field, expected)
            rows.append((name, ok, "" if ok else f"unexpected reply {json.dumps(reply)[:200]}"))
        except Exception as e:  # a failed check is a result
            rows.append((name, False, str(e)[:200]))
    every = all(r[1] for r in rows)
    return spark.createDataFrame([(*r, every) for r in rows], "name string, ok boolean, detail string, all_ok boolean")
