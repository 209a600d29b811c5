import io
import json

import pytest

from tallyspark import tools

from .test_store import MAR, SOL


@pytest.fixture
def book(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "mar.csv").write_text(MAR.replace("Oxxo Centro", "Oxxo `Centro`"), encoding="utf-8")
    (box / "sol.csv").write_text(SOL, encoding="utf-8")
    (box / "notes.md").write_text("x")
    accounts = [{"account_id": a, "name": a, "institution": "Banco", "currency": "MXN", "type": "debito"} for a in ("mar_debito", "sol_ahorro")]
    (tmp_path / "c.json").write_text(json.dumps({"accounts": accounts, "rules": [], "key": "k"}))
    return tools.Ledger(spark, f"file://{tmp_path}/ledger", str(tmp_path / "c.json"), str(box))


def test_a_month_by_messages(book):
    def call(name, **arguments):
        reply = tools.answer(book, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
        said = reply["content"][0]["text"]
        return said if reply.get("isError") else json.loads(said)

    assert call("finance_list_inbox") == {"files": ["mar.csv", "sol.csv"]}
    assert "outside" in call("finance_preview_import", path="../c.json") and "unknown ['x']" in call("finance_system_status", x=1)
    run = call("finance_preview_import", path=".")["run_id"]
    assert "seal" not in call("finance_get_run", run_id=run) and call("finance_get_review_queue", run_id=run)["review_queue"] == []
    one = book._staged(run).rows.first()["transaction_id"]
    fixed = call("finance_apply_corrections", run_id=run, corrections=[{"transaction_id": one, "field": "category", "value": "Casa"}, {"transaction_id": "no", "field": "category", "value": "x"}])
    assert fixed["applied"] == 1 and fixed["rejected"][0]["why"] == "unknown transaction"
    assert "confirm" in call("finance_commit_import", run_id=fixed["run_id"])
    assert call("finance_commit_import", run_id=fixed["run_id"], confirm=True)["transactions"] == 5
    assert call("finance_system_status")["counts"]["corrections"] == 1
    assert [a["closed"] for a in call("finance_audit_month", month="2026-06")["accounts"]] == [True, True]
    assert call("finance_close_month", month="2026-06")["all_closed"]
    assert call("finance_refresh_excel")["n_rows"] == 5
    assert "closed" in call("finance_rollback_import", import_id=fixed["run_id"], confirm=True)
    assert "quarantine" in call("finance_resolve_quarantine", transaction_id=one, reason="r", confirm=True)


def test_protocol(book):
    out = io.StringIO()
    tools.serve(book, io.StringIO('{"id":1,"method":"initialize"}\n\nnonsense\n{"method":"notifications/initialized"}\n{"id":2,"method":"tools/list"}\n{"id":3,"method":"else"}\n{"id":4,"method":"tools/call","params":{"name":"no"}}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("id") for r in replies] == [1, None, 2, 3, 4]
    assert replies[0]["result"]["protocolVersion"] == tools.PROTOCOL and len(replies[2]["result"]["tools"]) == 14
    assert [replies[k]["error"]["code"] for k in (1, 3)] == [-32700, -32601] and replies[4]["result"]["isError"]


def test_harmless_results():
    assert tools.harmless({"a\x07": ["`x`\n", 1, None, ("y\x1b",)]}) == {"a": ["'x'\n", 1, None, ["y"]]}
    assert tools.masked("mar_debito_1234") == "mar••••1234" and tools.masked("short") == "short"


def test_paths_stay_inside(tmp_path):
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "link").symlink_to(tmp_path)
    assert tools.inside(str(tmp_path / "box"), "a.csv").endswith("/box/a.csv")
    for path in ("..", "/etc/passwd", "link/c.json", "../boxer"):
        with pytest.raises(tools.ToolError):
            tools.inside(str(tmp_path / "box"), path)
