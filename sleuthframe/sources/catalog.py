"""Modules for which a better choice exists.

imports: the modules, with all below them; exclude: those among them that don't
count; also: only where the code base imports this too; complex: only for
command lines of some size.
"""

from __future__ import annotations


def _p(imports: str, suggest: str, **more: object) -> dict:
    return {"imports": imports.split(), "suggest": suggest} | more


PATTERNS: list[dict] = [
    _p("urllib.request http.client", "requests or httpx"),
    _p("argparse", "click or typer", complex=True),
    _p("xml.dom.minidom", "xml.etree.ElementTree or lxml"),
    _p("configparser", "tomllib with tomli-w, or pydantic-settings"),
    _p("xmlrpc.client xmlrpc.server", "JSON over HTTP, by requests or httpx"),
    _p("ftplib", "SFTP by paramiko, or the SDK of a cloud store"),
    _p("os.path", "pathlib, which this code uses elsewhere", also="pathlib"),
    _p("unittest", "pytest, which this code uses elsewhere", exclude=["unittest.mock"], also="pytest"),
    _p("logging", "structlog, which this code uses elsewhere", also="structlog"),
    _p("sqlite3", "sqlalchemy, which this code uses elsewhere", also="sqlalchemy"),
    _p("threading multiprocessing", "concurrent.futures, which this code uses elsewhere", also="concurrent.futures"),
    _p("cgi cgitb", "a WSGI or ASGI framework; gone since Python 3.13"),
    _p("imp", "importlib; gone since Python 3.12"),
    _p("distutils", "setuptools or hatchling; gone since Python 3.12"),
    _p("telnetlib", "paramiko or asyncssh; gone since Python 3.13"),
    _p("nntplib", "an HTTP interface; gone since Python 3.13"),
    _p("pkg_resources", "importlib.metadata and importlib.resources"),
    _p("nose", "pytest; nose has no maintainer"),
    _p("mock", "unittest.mock or pytest-mock"),
    _p("six", "plain Python 3"),
]
