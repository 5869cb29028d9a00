"""The fold of records against a sequential statement of its rules."""

import random
import re

import pytest

from orgweave.operators import resolve

NOISE = {"the", "inc", "llc", "ltd", "co", "corp", "company", "group", "and"}
RANK = {"high": 0, "medium": 1, "low": 2}
SCHEMA = "agency string, seq bigint, client_name string, client_domain string, source string, confidence string, method string, derived boolean"


def toks(s):
    return [t for t in re.split("[^a-z0-9]+", s.lower()) if len(t) > 1]


def key(s):
    t = toks(s)
    return " ".join([x for x in t if x not in NOISE] or t)


def squash(s):
    return re.sub("[^a-z0-9]+", "", s.lower())


def same_brand(name, domain):
    stem = domain.split(".")[0]
    a, b = sorted((squash(name), squash(stem)), key=len)
    if not a:
        return False
    return a == b or (len(a) >= 6 and b.startswith(a)) or len(set(toks(name)) & set(toks(stem))) >= 2


def fold(records):
    """Clients of one agency: merge in order, fold names into links, lift, attach."""
    clients, index = [], {}
    for _, seq, name, domain, source, conf, method, derived in records:
        k = key(name)
        if not k:
            continue
        if k not in index:
            index[k] = {"seq": seq, "names": [], "domain": None, "best": None, "methods": set()}
            clients.append(index[k])
        c = index[k]
        c["names"].append((name, derived))
        c["domain"] = c["domain"] or domain
        c["methods"].add(method)
        if c["best"] is None or RANK[conf] < c["best"][0]:
            c["best"] = (RANK[conf], source)
    for c in clients:
        written = [n for n, d in c["names"] if not d]
        c["name"] = max(written, key=len) if written else c["names"][0][0]  # max keeps the first of equals
        c["derived"] = not written
        c["rank"], c["source"] = c["best"]
    gone = []
    for c in clients:
        if c["domain"]:
            continue
        for link in clients:
            if link["domain"] and same_brand(c["name"], link["domain"]):
                if link["derived"] or (squash(c["name"]).startswith(squash(link["name"])) and len(c["name"]) > len(link["name"])):
                    link["name"], link["derived"] = c["name"], False
                link["methods"] |= c["methods"]
                link["rank"] = min(link["rank"], c["rank"])
                gone.append(c)
                break
    clients = [c for c in clients if c not in gone]
    for c in clients:
        if len(c["methods"]) > 1 and c["rank"] == 1:
            c["rank"] = 0
        c["source"] = "+".join(sorted(c["methods"])) + " | " + c["source"]
    linked = [(set(key(c["name"]).split()), c["domain"]) for c in clients if c["domain"]]
    for c in clients:
        if c["domain"]:
            continue
        mine = set(key(c["name"]).split())
        for other, domain in linked:
            shared = len(mine & set(toks(domain.split(".")[0])))
            if (shared and shared >= min(2, len(mine))) or mine == other:
                c["domain"] = domain
                c["source"] += f" | domain matched to {domain}"
                break
    return {(c["seq"], c["name"], c["domain"], c["rank"], c["source"], tuple(sorted(c["methods"]))) for c in clients}


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    r = random.Random(seed)
    words = ["oak", "elm", "summit", "harbor", "lakeside", "dermatology", "roofing", "co", "the", "a1"]
    records = []
    for i in range(400):
        name = " ".join(r.sample(words, r.randint(1, 3))).title()
        stem = r.choice(["".join, "-".join])(r.sample(words, r.randint(1, 2)))
        domain = f"{stem}.test" if r.random() < 0.4 else None
        records.append((f"g{r.randint(0, 5)}.test", i, name, domain, f"s{i}", r.choice(list(RANK)), r.choice(["alt", "file", "link"]), r.random() < 0.3))
    got = {}
    for x in resolve.fold_pages(spark.createDataFrame(records, SCHEMA)).collect():
        got.setdefault(x.agency, set()).add((x.seq, x.client_name, x.client_domain, x["rank"], x.source, tuple(x.methods)))
    for agency in {x[0] for x in records}:
        assert got[agency] == fold([x for x in records if x[0] == agency])
