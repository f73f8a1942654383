import base64
import hashlib
import json
import re

from apexframe.llm import secret_scan as S

FOLDER = "/root/testdata/sf0.001"


def brute_base(text):
    """The patterns as they are given, with nothing skipped beforehand."""
    word = "".join
    any_case = lambda s: word(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    names = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
    rules = [
        ("assign", re.compile(f"({names})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, rule, ok) in enumerate(rules) for m in rule.finditer(text or "") if ok(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def tlv(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = tlv(0x30, number(0) + b"".join(number(3**k) for k in range(40, 48)))
WRAPPED = tlv(0x30, number(0) + tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b"")) + tlv(4, RSA))
CURVE = tlv(0x30, number(1) + tlv(4, b"k" * 32) + tlv(0xA0, tlv(6, b"\x2b\x81\x04\x00")))
PUBLIC = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b"")) + tlv(3, b"\0" + tlv(0x30, number(3**90) + number(65537))))
string = lambda b: len(b).to_bytes(4, "big") + b
SSH = S.MAGIC + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(b"public") + string(b"private" * 9)
b64 = lambda b: base64.b64encode(b).decode()
url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")


def token(alg, signature):
    return ".".join([url(json.dumps({"alg": alg, "typ": "JWT"}).encode()), url(b'{"sub":"1"}'), url(signature)])


def kinds(text):
    return [(S.KINDS[k], text[a:b]) for a, k, b in S.spans(text) if k >= 3]


def test_keys_and_tokens_are_confirmed():
    assert kinds("é " + b64(RSA) + " x") == [("der", b64(RSA))]
    assert kinds(url(WRAPPED)) == [("der", url(WRAPPED))] and kinds(CURVE.hex().upper()) == [("der", CURVE.hex().upper())]
    assert kinds(b64(SSH)) == [("ssh", b64(SSH))]
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(RSA))) + "\n-----END RSA PRIVATE KEY-----"
    assert kinds("a " + block + " b") == [("der", block)]
    for alg, n in (("HS256", 32), ("RS256", 256), ("ES512", 132)):
        assert kinds(f"see {token(alg, b's' * n)}, ok") == [("jwt", token(alg, b"s" * n))]


def test_what_only_looks_alike_is_not():
    for data in (PUBLIC, RSA[:-1], RSA + b"\0", b"\x30\x80" + RSA, tlv(0x30, number(0)), b"plain text that is long enough to be one", SSH[:-1], SSH + b"x"):
        assert kinds(b64(data)) == [] and kinds(data.hex()) == []
    assert kinds(token("none", b"s" * 32)) == kinds(token("HS256", b"s" * 31)) == kinds("aaaaaaaaaa.bbbb.cccc") == kinds("a" * 100_000) == []


EDGES = [
    (1, None), (2, ""), (3, "password=12345678"), (4, "PassWord\" : 'abcdefgh"), (5, "password=1234567"), (6, "token=tooshort_no secret=short api_key=longenough1 APIKEY:longenough2"),
    (7, "ſecret=longenough1 toKen=longenough1"), (8, "AKIA1234567890AB AKIAAKIAAKIA1234 AKIA123"), (9, "é" * 10 + "0123456789abcdef" * 2), (9, "x" * 300_000 + " secret==longenough"),
    (None, "password==password=abcdefgh"), (10, b64(RSA)), (10, b64(RSA)), (11, "f" * 31 + "g" + "f" * 32), (12, "secret: " + "0123456789abcdef" * 2),
]


def test_edge_rows_and_whole_table(make, spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for docs, rows in ((make(EDGES), EDGES), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        got = S.summary(S.secrets(docs)).collect()
        wanted = sorted(((i, brute_base(t)) for i, t in rows), key=str)
        base = lambda spans: ",".join(s for s in spans.split(",") if s.split(":")[0] in S.BASE)
        assert sorted(((r.doc_id, base(r.spans)) for r in got), key=str) == wanted
        for r in got:
            assert r.base_sha256 == hashlib.sha256(base(r.spans).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k + ":") for s in r.spans.split(",")) for k in S.BASE]
    assert any(r.n_der for r in S.summary(S.secrets(make(EDGES))).collect())


def test_empty_table(make):
    assert S.summary(S.secrets(make([]))).count() == 0


def armour(label, body):
    return f"-----BEGIN {label}-----{body}-----END {label}-----"


def lines_of(data, width=64):
    return re.findall(f".{{1,{width}}}", b64(data))


PBES = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(0x30, tlv(4, b"salt" * 2))))) + tlv(4, b"c" * 640))
DIGEST = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")) + tlv(5, b"")) + tlv(4, b"h" * 32))


def test_armour_with_escaped_line_ends():
    for end in ("\\n", "\\r\\n", "\\\\n"):
        for label, data, kind in (("PRIVATE KEY", WRAPPED, "der"), ("OPENSSH PRIVATE KEY", SSH, "ssh")):
            block = armour(label, end + end.join(lines_of(data)) + end)
            assert kinds('{"private_key": "' + block + end + '", "a": 1}') == [(kind, block)]


def test_armour_with_headers():
    heads = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    for end in ("\n", "\r\n", "\\n"):
        block = armour("RSA PRIVATE KEY", (heads + "\n".join(lines_of(b"\x9f" * 640)) + "\n").replace("\n", end))
        assert kinds("x " + block) == [("der", block)]
    odd = armour("RSA PRIVATE KEY", heads + "\n".join(lines_of(b"\x9f" * 641)) + "\n")
    plain = armour("RSA PRIVATE KEY", "\nComment: mine\n\n" + "\n".join(lines_of(RSA)) + "\n")
    assert kinds(odd) == [] and kinds(plain) == [("der", plain)]
    assert kinds(armour("RSA PRIVATE KEY", "\nthe key goes here, see the notes\n")) == []


def test_encrypted_keys():
    block = armour("ENCRYPTED PRIVATE KEY", "\n" + "\n".join(lines_of(PBES)) + "\n")
    assert kinds(block) == [("der", block)] and kinds(b64(PBES)) == [("der", b64(PBES))]
    assert kinds(b64(DIGEST)) == kinds(b64(PBES[:-1])) == []


def test_wrapped_base64_without_armour():
    for data, kind in ((RSA, "der"), (WRAPPED, "der"), (PBES, "der"), (SSH, "ssh")):
        for width in (64, 76):
            for joint in ("\n", "\r\n", "\\n", "\n  > "):
                wrapped = joint.join(lines_of(data, width))
                for before, after in (("", ""), ("key:\n", "\nand more text"), ("the key" + joint, joint + "word")):
                    assert kinds(before + wrapped + after) == [(kind, wrapped)], (kind, width, joint, before)
    assert kinds("\n".join(lines_of(PUBLIC * 9))) == kinds("\n".join(lines_of(RSA[:-1]))) == []


def test_openssh_keys_in_hexadecimal():
    assert kinds("x " + SSH.hex() + " y") == [("ssh", SSH.hex())] and kinds(SSH.hex().upper()) == [("ssh", SSH.hex().upper())]


def test_time_grows_with_the_length_of_lines_that_look_like_keys():
    """Megabytes of lines that each begin like a key: no line is read once per line before it."""
    import random
    import time

    rng = random.Random(1)
    line = lambda: rng.choice(["b3BlbnNzaC1rZXktdjEA", "MIIE" + "A" * 16, "MIQAAAAA" + "AgEA" * 3]) + "".join(rng.choice("ABCabc") for _ in range(44))
    seconds = []
    for megabytes in (1, 2, 4):
        text = "\n".join(line() for _ in range(megabytes << 14))
        start = time.perf_counter()
        assert not [s for s in S.spans(text) if s[1] in (3, 4)]
        seconds.append(time.perf_counter() - start)
    assert seconds[2] < 10 * seconds[0] and seconds[2] < 20
