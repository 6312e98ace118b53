"""Prompts and fixed answers as Column expressions.

The texts are fixed values: what a model is asked, and what is said without one,
is defined by them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.unicode import three_places

NO_CONTEXT = "Minh chua tim thay du lieu noi bo phu hop cho cau hoi nay. Hay bo sung tai lieu vao kho du lieu va thu lai."
NO_EVIDENCE = "- Khong co evidence rut gon; hay trich truc tiep tu context."

FACTS = """Ban la bo loc su kien cho tro ly hoc tap noi bo.
NHIEM VU PASS 1: Rut su kien dung va du tu context, khong duoc suy doan them.
LUAT CUNG:
1) CHI dung thong tin trong context/evidence.
2) Moi su kien phai co trich dan [Nguon X].
3) Neu thay mau thuan giua cac nguon, ghi ro MAU_THUAN + trich dan.
4) Neu thieu thong tin de ket luan, ghi THIEU_DU_LIEU.
Loai cau hoi: {intent}
Do tin cay truy hoi: {confidence}

Evidence rut gon:
{evidence}

Context day du:
{contexts}

Cau hoi: {question}

Dinh dang output bat buoc:
FACTS:
- <fact 1> [Nguon X]
- <fact 2> [Nguon Y]
CONFLICTS:
- <neu co>
MISSING:
- <neu co>"""

ANSWER = """Ban la tro ly hoc tap noi bo.
NHIEM VU PASS 2: Tong hop cau tra loi cuoi cung CHI tu FACTS ben duoi.
LUAT CUNG:
1) Khong them kien thuc ngoai FACTS.
2) Moi y quan trong phai kem [Nguon X].
3) Neu MISSING khong rong thi phai noi ro khong du du lieu.
4) Neu CONFLICTS khong rong thi neu mau thuan, khong tu chon bua.
Loai cau hoi: {intent}
Do tin cay truy hoi: {confidence}

FACT PACKAGE:
{facts}

Cau hoi: {question}

Dinh dang output:
1) Tra loi chinh (ngan gon, ro rang)
2) Giai thich bo sung (neu can)
3) Neu thieu du lieu: dua ra 1-2 cau hoi lam ro"""

LOCAL = """Khong goi duoc model LLM nen minh tong hop bang local fallback.

Tom tat su kien:
{facts}

Cau hoi goc: {question}
Neu ban can cau tra loi chat luong cao hon, hay bat Ollama/OpenAI/Gemini.

Nguon da dung:
{sources}"""


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its places."""
    parts: list[Column] = []
    for piece in template.split("{"):
        name, closed, rest = piece.partition("}")
        if closed and name in values:
            parts += [F.coalesce(values[name], F.lit("")), F.lit(rest)]
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def asked() -> dict[str, Column]:
    """What every prompt tells: of the columns intent, confidence and text."""
    return {"intent": F.col("intent"), "confidence": three_places("confidence"), "question": F.col("text")}


def facts_prompt() -> Column:
    """F19, first pass; of asked() and the columns citations, context_text."""
    return filled(FACTS, **asked(), evidence=F.when(F.coalesce("citations", F.lit("")) == "", NO_EVIDENCE).otherwise(F.col("citations")), contexts=F.col("context_text"))


def answer_prompt(facts: Column) -> Column:
    """F19, second pass."""
    return filled(ANSWER, **asked(), facts=facts)


def local_answer(facts: Column) -> Column:
    """what is said without a model's answer; without contexts, H5's text."""
    return F.when(F.col("sources_text").isNull(), NO_CONTEXT).otherwise(filled(LOCAL, facts=facts, question=F.col("text"), sources=F.col("sources_text")))
