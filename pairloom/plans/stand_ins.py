"""Models' places taken by fixed rules on the whole prompt, so that results can be checked."""

from __future__ import annotations

from pairloom.operators.generation import MakeFn


def digest_model(label: str, echo: bool = False) -> MakeFn:
    """Answers with the MD5 of label and prompt, after the prompt itself if ``echo``."""

    def make():
        from hashlib import md5

        def answer(prompts):
            return [
                (prompt if echo else "") + md5((label + prompt).encode()).hexdigest()
                for prompt in prompts
            ]

        return answer

    return make


def digest_chat_model(label: str) -> MakeFn:
    """The same for message lists: the answer to the last message is added to the list."""

    def make():
        from hashlib import md5

        def answer(chats):
            return [
                [*chat, {
                    "role": "assistant",
                    "content": md5((label + chat[-1]["content"]).encode()).hexdigest(),
                }]
                for chat in chats
            ]

        return answer

    return make


def digest_judge() -> MakeFn:
    """Ends its answer with 0 or 1, or with a letter: by the last hex digit of the question."""

    def make():
        from hashlib import md5

        def answer(questions):
            ends = (md5(question.encode()).hexdigest()[-1] for question in questions)
            return [
                "The better one is " + ("0\n" if end < "8" else "1" if end < "f" else "f")
                for end in ends
            ]

        return answer

    return make


def digest_chat_judge() -> MakeFn:
    """The same judge for message lists."""
    make_plain = digest_judge()

    def make():
        answer = make_plain()
        return lambda chats: [
            [*chat, {"role": "assistant", "content": reply}]
            for chat, reply in zip(chats, answer([chat[-1]["content"] for chat in chats]))
        ]

    return make
