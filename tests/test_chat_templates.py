import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.functions import TemplateError, compile_template

CHATS = {
    "asked": [("user", " a ")],
    "answered": [("user", "a"), ("assistant", "b"), ("user", "c")],
    "system": [("system", " be brief\n"), ("user", "a"), ("assistant", "")],
    "empty": [],
    "odd": [("tool", "x"), ("user", "é ")],
}


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(name, [(role, content, role[0]) for role, content in turns]) for name, turns in CHATS.items()]
    return spark.createDataFrame(rows, "name string, chat array<struct<role:string,content:string,mark:string>>")


def render(chats, source, add_generation_prompt=False, **names):
    template = compile_template(source, **names)
    out = op.apply_chat_template(chats, ["chat"], template, "conversational", add_generation_prompt)
    return {row.name: row.chat for row in out.collect()}


def both(chats, source, wanted, **options):
    """Compare with a Python function of (role, content) pairs."""
    assert render(chats, source, **options) == {name: wanted(turns) for name, turns in CHATS.items()}


def test_turns_one_after_another(chats):
    source = (
        "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>'"
        " + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
    )

    def wanted(turns, end=""):
        return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in turns) + end

    both(chats, source, wanted)
    both(chats, source, lambda turns: wanted(turns, "<|im_start|>assistant\n"), add_generation_prompt=True)


def test_a_system_turn_set_apart(chats):
    source = """
{%- if messages[0].role == 'system' %}
    {%- set rest = messages[1:] %}{% set system = messages[0]['content'].strip() %}
{%- else %}
    {%- set rest = messages %}{% set system = false %}
{%- endif %}
{%- for message in rest -%}
    {%- if loop.first and system -%}
        {%- set content = '<<' + system + '>>' + message.content %}
    {%- else %}
        {%- set content = message.content -%}
    {%- endif %}
    {%- if message['role'] == 'user' %}
        {{- bos_token ~ 'Q' ~ loop.index0 ~ content | trim }}
    {%- elif message['role'] == 'assistant' %}
        {{- 'A' ~ content ~ eos_token }}
    {%- else %}?{% endif %}
{%- endfor %}"""

    def wanted(turns):
        system = turns[0][1].strip() if turns and turns[0][0] == "system" else ""
        rest, out = turns[1:] if system else turns, ""
        for i, (role, content) in enumerate(rest):
            content = f"<<{system}>>{content}" if i == 0 and system else content
            out += {"user": f"<s>Q{i}{content.strip()}", "assistant": f"A{content}</s>"}.get(role, "?")
        return out

    both(chats, source, wanted, bos_token="<s>", eos_token="</s>")


def test_loop_names_and_neighbours(chats):
    source = (
        "{% for m in messages %}[{{ loop.index }}/{{ loop.length }}{% if loop.first %}F{% endif %}"
        "{{ 'L' if loop.last else '' }} {{ loop.previtem.role }}<{{ m.role | upper }}>{{ loop.nextitem.role }}"
        "{% if loop.previtem is defined and loop.previtem.content == '' %}!{% endif %}]{% endfor %}"
    )

    def wanted(turns):
        out, n = "", len(turns)
        for i, (role, _) in enumerate(turns):
            before, after = (turns[j][0] if 0 <= j < n else "" for j in (i - 1, i + 1))
            out += f"[{i + 1}/{n}{'F' * (i == 0)}{'L' * (i == n - 1)} {before}<{role.upper()}>{after}"
            out += "!]" if i and turns[i - 1][1] == "" else "]"
        return out

    both(chats, source, wanted)


def test_slices_filters_and_lists(chats):
    source = (
        "{{ messages | length }};{{ messages[-1].role }};{{ (messages | first).mark }};"
        "{% for m in messages[:-1] %}{{ m.mark }}{% endfor %};{% for m in messages[-2:] %}{{ m.mark }}{% endfor %};"
        "{% for m in messages[::-1] %}{{ m.mark }}{% endfor %};"
        "{% for m in messages if m.role not in ['system', 'tool'] %}{{ loop.index }}{{ m.mark }}{% endfor %};"
        "{% if 'b' in messages[1].content %}yes{% endif %}{{ messages[0].nothing }}{{ messages[0].nothing is defined }}"
    )

    def wanted(turns):
        marks = "".join(role[0] for role, _ in turns)
        kept = [role[0] for role, _ in turns if role not in ("system", "tool")]
        return (
            f"{len(turns)};{turns[-1][0] if turns else ''};{marks[:1]};{marks[:-1]};{marks[-2:]};{marks[::-1]};"
            + "".join(f"{i + 1}{mark}" for i, mark in enumerate(kept)) + ";"
            + ("yes" if len(turns) > 1 and "b" in turns[1][1] else "") + "False"
        )

    both(chats, source, wanted)


def test_texts_and_methods(chats):
    source = (
        "{% for m in messages %}{{ m.content.strip() | length }}{{ m.content.split('a')[0] }}|"
        "{{ m.content.startswith('b') }}{{ m.content | replace('a', 'A') | trim }}{{ m.role | capitalize }}"
        "{{ m.missing | default('-') }}{% if loop.index % 2 == 0 and not loop.last or m.role == 'tool' %}+{% endif %}"
        "{{ '%' if loop.index0 // 2 > 0 }}{% endfor %}"
    )

    def wanted(turns):
        out = ""
        for i, (role, content) in enumerate(turns):
            out += f"{len(content.strip())}{content.split('a')[0]}|{content.startswith('b')}"
            out += content.replace("a", "A").strip() + role.capitalize() + "-"
            out += "+" * (((i + 1) % 2 == 0 and i != len(turns) - 1) or role == "tool") + "%" * (i // 2 > 0)
        return out

    both(chats, source, wanted)


def test_blanks_around_blocks(chats):
    source = (
        "{# note #}\n{% if true %}\n  x\n  {% endif %}\ny {{ 1 }}\n   {%- if false %}no{% else %} z{% endif %}\n\n"
        "{%- set a = 'b' -%}   w{{- a -}}  v\n"
    )
    both(chats, source, lambda turns: "  x\ny 1 zwbv")


def test_dead_branches_may_hold_anything(chats):
    source = (
        "{% if tools is defined and tools %}{{ tools | tojson(indent=4) }}{% endif %}"
        "{% if documents %}{% set ns = namespace(x) %}{% endif %}{{ date_string | default('today') }}{{ mode }}"
    ).replace("(indent=4)", "(4)")
    both(chats, source, lambda turns: "todayfast", mode="fast")


def test_a_template_may_refuse_a_chat(chats):
    source = (
        "{% for m in messages %}{% if (m.role == 'user') != (loop.index0 % 2 == 0) %}"
        "{{ raise_exception('roles must alternate: ' + m.role) }}{% endif %}{{ m.content }}{% endfor %}"
    )
    fine = chats.where("name in ('asked', 'answered', 'empty')")
    assert render(fine, source) == {"asked": " a ", "answered": "abc", "empty": ""}
    with pytest.raises(Exception, match="roles must alternate: system"):
        render(chats.where("name = 'system'"), source)


@pytest.mark.parametrize("source, reason", [
    ("{% for m in messages %}", "endfor"), ("{% if a %}x", "endif"), ("{{ a b }}", "cannot read"),
    ("{{ }}", "ends early"), ("{{ 'a }}", "cannot read"), ("{% macro f() %}{% endmacro %}", "macro"),
    ("{% for m in messages %}{% for n in messages %}{{ n.role }}{% endfor %}{% endfor %}", "loop within a loop"),
    ("{{ messages }}", "cannot be written"), ("{{ namespace() }}", "namespace"), ("{{ messages | tojson }}", "tojson"),
    ("{{ loop.index }}", "nothing"), ("{% set x %}", "cannot set"), ("{{ messages[0].role + 1 }}", "cannot add"),
])
def test_what_is_not_offered_is_refused_by_name(chats, source, reason):
    with pytest.raises(TemplateError, match=reason):
        render(chats, source)


def test_plain_texts_and_nulls(spark):
    table = spark.createDataFrame([("x",), (None,)], "prompt string")
    template = compile_template("{% for m in messages %}{{ m.role }}:{{ m.content }};{% endfor %}")
    kept = table.where(F.col("prompt").isNotNull())
    out = op.apply_chat_template(kept, ["prompt"], template, system_prompt="s")
    assert [row.prompt for row in out.collect()] == ["system:s;user:x;"]
    with pytest.raises(Exception, match="null message in prompt"):
        op.apply_chat_template(table, ["prompt"], template).collect()
    loose = op.apply_chat_template(table, ["prompt"], template, on_null="propagate", new_columns=["out"])
    assert sorted((row.out or "") for row in loose.collect()) == ["", "user:x;"]


def test_no_python_in_the_plan(chats, plan_of):
    template = compile_template("{% for m in messages %}{{ m.role }}{% endfor %}")
    plan = plan_of(op.apply_chat_template(chats, ["chat"], template, "conversational"))
    assert "Python" not in plan and "Arrow" not in plan
