"""Addresses, origins and payment requirements of requests."""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NETWORK = re.compile(r"[a-z0-9]{1,32}:[A-Za-z0-9_-]{1,128}\Z")


def _address(text: str):
    text = text.strip()
    if text.startswith("["):
        text = text[1:].split("]", 1)[0]
    elif text.count(":") == 1:
        text = text.split(":", 1)[0]
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def client_ip(remote: str | None, forwarded: str | None, trusted: Iterable[str] = ()) -> str:
    """The peer, unless it is a trusted proxy: then the last forwarded address that isn't one."""
    nets = [ipaddress.ip_network(t if "/" in t else t + ("/128" if ":" in t else "/32"), strict=False) for t in trusted]
    peer = _address(remote or "")
    if peer is None:
        return (remote or "").strip()
    own = lambda a: any(a.version == n.version and a in n for n in nets)
    if own(peer):
        for part in reversed((forwarded or "").split(",")):
            found = _address(part)
            if found is None:
                break
            if not own(found):
                return str(found)
    return str(peer)


def client_ips(trusted: Iterable[str]) -> Callable[[Column, Column], Column]:
    """A column function (remote, forwarded) -> address; parsing addresses of both kinds is beyond built-in functions."""
    nets = tuple(trusted)

    @F.pandas_udf(StringType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for remotes, forwardeds in parts:
            yield pd.Series([client_ip(r, f, nets) for r, f in zip(remotes, forwardeds)])

    return run


def origin_allowed(origin: str, allowed: Iterable[str]) -> bool:
    """No origin at all passes; others have to be listed, by scheme and host, and by port if the entry has one."""
    shape = re.compile(r"(?:(?P<scheme>[a-z][a-z0-9+.-]*)://)?(?P<host>\[[^\]]*\]|[^:/]*)(?::(?P<port>\d+))?/?\Z")
    if not origin.strip():
        return True
    got = shape.match(origin.strip().lower())
    for entry in allowed:
        want = shape.match(entry.strip().lower())
        if got and want and want["host"] and got["host"] == want["host"] and want["scheme"] in (None, got["scheme"]) and want["port"] in (None, got["port"]):
            return True
    return False


def bearer_allowed(header: str | None, token: str, mode: str = "auto") -> bool:
    """Whether an Authorization header carries the token; anything passes in the mode none. Compared in constant time."""
    if mode.strip().lower() == "none":
        return True
    scheme, _, given = (header or "").strip().partition(" ")
    return scheme.lower() == "bearer" and bool(token) and bool(given.strip()) and hmac.compare_digest(given.strip().encode(), token.encode())


def requirement_errors(requirement: dict) -> list[str]:
    """What is wrong with a payment requirement; amounts are whole numbers as text."""
    errors = [f"{name} is missing" for name in ("scheme", "network", "amount", "asset", "pay_to") if not str(requirement.get(name) or "").strip()]
    if requirement.get("network") and not NETWORK.match(str(requirement["network"])):
        errors.append("network isn't a chain id")
    if requirement.get("amount") and not re.fullmatch(r"[0-9]{1,78}", str(requirement["amount"])) or str(requirement.get("amount")).strip("0") == "":
        errors.append("amount isn't a positive whole number")
    return errors
