"""Prompts and temperatures of the answer loops.

A prompt is its task's name, instructions, a line of dashes, and the material in labelled parts. Replies that are parsed
are asked for as JSON of the fields that the loops read, as one of the labels, or as lines with a dash.
"""

from __future__ import annotations

from quern.functions import fixed

MARK = "-----"

#: Task -> (temperature, instructions).
TASKS: dict[str, tuple[float, str]] = {
    "ANALYSE": (0.1, 'You prepare a search in a corpus of laws. Reply with one JSON object and nothing else: "laws" lists the names of laws, codes or decrees that the question names or plainly needs; "search_queries" lists up to five short queries, in the language of the question, that would find the articles that answer it; "is_complete" says whether the question can be understood as it is.'),
    "HYPOTHETICAL": (0.7, "Write, in the language of the question, the passage of a law that would answer it: three to five sentences in the style of an article, without a number of your own making."),
    "ASSESS": (0.0, 'You are given a question and the articles found so far, a line each. Reply with one JSON object and nothing else: "is_complete" is true if these articles are enough for a full answer; "gaps" says in a sentence what is missing; "follow_up_queries" lists up to three short queries for what is missing.'),
    "CLASSIFY": (0.0, "Which kind of question is this? Reply with one of these labels and nothing else: " + ", ".join(fixed.QUERY_KINDS) + "."),
    "EXPAND": (0.3, "Say the question in other words, as many times as the number below says. Keep its meaning and its language. One line each, starting with a dash."),
    "DECOMPOSE": (0.1, "Split the question into the questions that have to be answered one by one. One line each, starting with a dash; a question that needs no splitting is a single line."),
    "RECOMPOSE": (0.1, "Put the answers of the parts together into one answer to the whole question. Keep every reference to an article; say nothing that the parts don't say."),
    "RERANK": (0.0, "Which of the numbered passages help to answer the question? Reply with their numbers, most helpful first, separated by commas, and nothing else."),
    "ANSWER": (0.1, "Answer the question from the numbered passages alone, in the language of the question. Name the law and the article for every statement. If the passages don't answer it, say what is missing."),
    "USEFUL?": (0.0, "Does the answer deal with the question and say something definite? Reply USEFUL or NOT_USEFUL and nothing else."),
    "CORRECT": (0.2, "Compare the answer with the passages. If every statement is borne out by them, reply OK. Otherwise reply with the corrected answer and nothing else."),
    "EDIT": (0.1, "Edit the answer for order and wording without changing what it says. Reply with the edited answer and nothing else."),
}


def prompt(task: str, **parts: object) -> str:
    """The prompt of a task; ``parts`` become labelled parts, in order, empty ones left out."""
    body = "\n\n".join(f"{name.upper()}\n{value}" for name, value in parts.items() if value not in ("", None))
    return f"{task}\n{TASKS[task][1]}\n{MARK}\n{body}"


def temperature(task: str) -> float:
    return TASKS[task][0]


def part(text: str, name: str) -> str:
    """The part of a prompt with that label, which is to be its last."""
    return text.split(f"{MARK}\n", 1)[-1].split(f"{name.upper()}\n", 1)[-1]
