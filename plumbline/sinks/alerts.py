"""Alerts: payloads are built here; a sender of each kind delivers them and can be replaced."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import smtplib
import urllib.request
from collections.abc import Callable
from email.message import EmailMessage
from typing import TYPE_CHECKING, Any

from .artifacts import shaped

if TYPE_CHECKING:
    from ..plans.results import RunResult

#: Details that are attached to mail as files, how many files, and how many links.
ATTACHED = ("missing_on_target", "extra_on_target", "mismatch_sample", "diff_sample")
MOST_FILES, MOST_LINKS = 3, 10
WEBHOOK_SECONDS = 10

ALERTS: dict[str, Callable[..., None]] = {}


def alert(kind: str):
    def add(f):
        ALERTS[kind] = f
        return f

    return add


def email_message(run: RunResult, recipients: list[str], sender: str) -> EmailMessage:
    """Text and HTML of the summary, links to files, and up to three attached samples."""
    from ..plans.results import csv_links
    from .render import markdown_table, summarize_run

    links = list(dict.fromkeys(u for c in run.checks for u in csv_links(c.details)))[:MOST_LINKS]
    text = summarize_run(run) + "\n\n" + markdown_table(run) + "".join(f"\n{u}" for u in links)
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = f"Data quality: {run.overall_status}", sender, ", ".join(recipients)
    m.set_content(text)
    m.add_alternative(f"<pre>{html.escape(text)}</pre>" + "".join(f'<p><a href="{html.escape(u)}">{html.escape(u)}</a></p>' for u in links), subtype="html")
    files = [(c, k) for c in run.checks if c.status == "FAIL" for k in ATTACHED if c.details.get(k)]
    for c, k in files[:MOST_FILES]:
        header, rows = shaped(c.details[k])
        out = io.StringIO()
        w = csv.DictWriter(out, header)
        w.writeheader()
        w.writerows(rows)
        m.add_attachment(out.getvalue().encode(), maintype="text", subtype="csv", filename=f"{c.table}-{c.check_type}-{k}.csv")
    return m


def addresses(value: Any) -> list[str]:
    parts = value.replace(";", ",").split(",") if isinstance(value, str) else list(value or [])
    return [p.strip() for p in parts if p and p.strip()]


@alert("email")
def send_email(run: RunResult, *, recipients: list[str]) -> None:
    host, port = os.environ.get("SMTP_HOST", "localhost"), int(os.environ.get("SMTP_PORT", "25"))
    with smtplib.SMTP(host, port, timeout=WEBHOOK_SECONDS) as smtp:
        if os.environ.get("SMTP_USER"):
            smtp.starttls()
            smtp.login(os.environ["SMTP_USER"], os.environ.get("SMTP_PASSWORD", ""))
        smtp.send_message(email_message(run, recipients, os.environ.get("SMTP_FROM", "plumbline@localhost")))


@alert("gchat")
def send_chat(run: RunResult, *, route: dict[str, Any], mode: str = "text") -> None:
    from .render import chat_card, chat_text

    everything = str(route.get("send_all_checks", "false")).lower() == "true"
    payload = chat_card(run, only_failures=not everything, context=run.metadata) if mode == "card" else chat_text(run, all_checks=everything)
    request = urllib.request.Request(route["webhook"], json.dumps(payload, default=str).encode(), {"Content-Type": "application/json; charset=UTF-8"})
    with urllib.request.urlopen(request, timeout=WEBHOOK_SECONDS):
        pass


def dispatch(routes: list[dict[str, Any]], run: RunResult, *, variables: dict[str, Any] | None = None, log: Any = None) -> None:
    """Sends the run by every route; a route that fails doesn't stop the others.

    Mail goes to the route's ``to`` (text or a list), else to the addresses in DQ_EMAILS.
    """
    for route in routes:
        kind = route.get("kind")
        try:
            if kind == "email":
                if to := addresses(route.get("to")) or addresses(os.environ.get("DQ_EMAILS")):
                    ALERTS["email"](run, recipients=to)
            elif kind in ALERTS:
                ALERTS[kind](run, route=route, mode=route.get("mode", "text"))
            else:
                raise ValueError(f"unknown alert {kind!r}")
        except Exception as e:  # noqa: BLE001  alerts don't fail runs
            if log:
                log("alert.error", level="WARNING", kind=kind, error=str(e))
