import random

import numpy as np
import pytest

from lodestrata.llm.prose import STATS, document_statistics, fit_prose, language, no_prose, outlierness, text_statistics

SENTENCES = ["The Company recognized $179.1 million of advertising revenue during fiscal 2022.", "No single customer accounted for more than 19 percent of total revenue.", "We do not expect further charges in the second quarter.", "The notes bear interest at 4% and mature on January 5, 2026."]
GERMAN = ["Der Vorstand erwartet für die kommenden 28 Monate eine schwächere Nachfrage.", "Mit Mexshax wurde ein Rahmenvertrag geschlossen, der jährlich kündbar ist.", "Die Rückstellungen wurden überprüft und nicht verändert."]


def prose(r, from_=SENTENCES):
    return " ".join(r.choice(from_) for _ in range(r.randint(4, 14)))


OTHERS = {
    "list": ["\n".join(f"* lower freight costs in region {i}" for i in range(20)), "\n".join(f"{a} Holdings" for a in "Alba Bera Cora Dora Enna Fara".split()), "Subsidiaries: " + ", ".join(f"Vel{a}" for a in "abel acorn adyne amont anor aqua arotis".split() * 3), "\n".join(f"Item {i} Risk Factors ... {i * 3}" for i in range(1, 15))],
    "table": ["\n".join(f"goodwill\t{i},123\t(2,{i}34)\t{i}.5%" for i in range(12)), "metric;current;prior\n" + "\n".join(f"backlog;{i},000;—" for i in range(9)), "<table>" + "".join(f"<tr><td>inventory</td><td>{i}</td><td>7,{i}11</td></tr>" for i in range(10)) + "</table>", "\n".join(f"2015 {i} 77{i} 9.{i}" for i in range(20)), "(in thousands)\n" + "\n".join(f"operating income           {i},548     (3,975)   4.1%" for i in range(9))],
    "junk": ["\n".join("=" * n for n in range(20, 40)), "9f3c" * 200, "Accept all cookies\n" * 25, "\n".join("x#jh{u [!~ q}8| 0$^ =w< ;p_@ /z k*" for _ in range(9)), "Ã¼eâ€™nï»¿vÃ©k Ã©oÃ¼uÂ§p " * 30],
}


def test_kinds_and_layouts_of_prose(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(300):
        rows.append((i, prose(r) if i % 3 else prose(r, GERMAN), r.choice(["en", "EN", "en-US", "eng"]) if i % 3 else "de"))
    import textwrap

    layouts = [textwrap.fill(prose(r), 44), prose(r).upper(), "\n\n".join(SENTENCES), "Speaker 7: " + prose(r) + "\n\nOperator: " + prose(r), "\n".join("  " + s for s in SENTENCES * 3), prose(r).lower().replace(".", "")]
    rows += [(1000 + i, t, "en") for i, t in enumerate(layouts)]
    for kind, texts in OTHERS.items():
        for t in texts:
            rows.append((2000 + len(want), t, r.choice(["en", "de", None, "x!"])))
            want[rows[-1][0]] = kind
    rows += [(3000, None, "en"), (3001, "", "en"), (3002, " \n ", "en"), (3003, prose(r) + "\n" + OTHERS["table"][0][:90], "en"), rows[-1]]
    documents = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, kind string")
    stats = document_statistics(documents, "doc_id", "text", "lang").cache()
    fitted = fit_prose(stats)
    got = {x["id"]: x["kind"] for x in no_prose(documents, "doc_id", "text", stats, fitted).collect()}
    assert got == want
    parts = outlierness(stats, fitted).first()
    assert sum(parts[f"{s}_part"] for s in STATS) == pytest.approx(parts["distance"] ** 2)
    assert len(stats.columns) == 3


def test_statistics_of_odd_texts():
    assert text_statistics(None) is None and text_statistics(" \n\t") is None
    for t in ("x", ".", "<b></b>", "決算短信を公表した。", "a" * 200_000, "퟿ 😀"):
        assert np.isfinite(text_statistics(t)).all() and len(text_statistics(t)) == len(STATS)
    assert [language(x) for x in ("en-US", "ENG", None, "", "klingon", "pt")] == ["en", "en", "und", "und", "und", "pt"]


def found(spark, rows):
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stats = document_statistics(documents, "doc_id", "text", "lang")
    return {tuple(x) for x in no_prose(documents, "doc_id", "text", stats, fit_prose(stats)).collect()}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_tables_count_without_any_prose_to_be_far_from(spark):
    rows = [(i, "\n".join(f"{i} {j} 7" for j in range(3)), "en") for i in range(5)]
    assert found(spark, rows) == {(i, "table") for i in range(5)}


ABROAD = {
    "pl": "Spółka odnotowała wzrost przychodów o dwanaście procent w drugim kwartale. Zarząd zatwierdził plan, który obejmuje dwieście etatów w regionie. Koszty energii były niższe niż rok wcześniej, głównie dzięki łagodnej zimie. Nie oczekujemy istotnych zmian w najbliższych miesiącach.",
    "ru": "Компания сообщила о росте выручки на двенадцать процентов во втором квартале. Совет директоров утвердил план, который затрагивает двести рабочих мест. Расходы на энергию были ниже, чем годом ранее, благодаря мягкой зиме. Мы не ожидаем существенных изменений.",
    "fi": "Yhtiön liikevaihto kasvoi kaksitoista prosenttia toisella neljänneksellä. Hallitus hyväksyi suunnitelman, joka koskee kahtasataa työpaikkaa alueella. Energiakustannukset olivat pienemmät kuin vuotta aiemmin. Luottosopimusta jatkettiin ilman ehtojen muutoksia.",
    "ja": "当社の第二四半期の売上高は前年同期比で十二パーセント増加しました。取締役会は地域の二百の職に影響する計画を承認しました。エネルギー費用は暖冬のため前年を下回りました。今後数か月に大きな変化は見込んでいません。",
    "th": "บริษัทรายงานรายได้เพิ่มขึ้นร้อยละสิบสองในไตรมาสที่สอง คณะกรรมการอนุมัติแผนที่มีผลต่อสองร้อยตำแหน่งในภูมิภาค ต้นทุนพลังงานต่ำกว่าปีก่อนเนื่องจากฤดูหนาวที่อบอุ่น",
}


def test_prose_of_any_language_in_any_layout_is_no_case(spark):
    import re
    import textwrap

    r = random.Random(4)
    rows = [(i, prose(r), "en") for i in range(200)]
    for lang, text in ABROAD.items():
        lines = lambda w: "\n".join([text[i : i + w] for i in range(0, len(text), w)] if lang == "ja" else textwrap.wrap(text, w))  # noqa: B023, E731
        rows += [(1000 + len(rows), t, g) for g in (lang, "en", None) for t in (lines(40), lines(60), text, "\n".join(re.findall("[^.。]+[.。]?", text)))]
    assert found(spark, rows) == set()


def test_distance_decides_and_names(spark):
    """Without the distance there is no outlier, so no row; the kind is that of the greatest part."""
    from lodestrata.llm import prose as module

    parts = np.zeros((4, len(STATS)))
    parts[0, STATS.index("cell_marks")], parts[1, STATS.index("marked_lines")], parts[2, STATS.index("odd_symbol_ratio")] = 90, 90, 90
    parts[3, STATS.index("cell_marks")] = module.FAR - 1
    assert list(module.named_outliers(parts)) == ["table", "list", "junk", None]
    parts[0, STATS.index("numeric_tokens")] = -80  # parts count by their sign
    parts[0, STATS.index("comma_marks")] = 40
    assert module.named_outliers(parts)[0] == "list"


def test_long_entries_are_entries():
    from lodestrata.llm.prose import line_kind

    assert line_kind("* consolidated subsidiaries operating distribution warehouses throughout continental territories including Luxembourg") == "list"
    assert line_kind("Notes to the consolidated financial statements of the Company and of its subsidiaries in all regions . . . . 12") == "list"
    assert line_kind("The notes to the consolidated financial statements of the Company and its subsidiaries cover all regions in full.") == "prose"
