import pytest

from quillspark.formats import crypto, docx, pdf, qr


def test_ciphers():
    key = bytes(range(16))
    data = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.AES(key).block(data).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.AES(bytes(range(32))).block(data).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.AES(key).unblock(crypto.AES(key).block(data)) == data
    assert crypto.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


def test_package():
    data = docx.Writer().paragraph("secret " * 500).save()
    locked = crypto.encrypt_package(data, "pässword", spins=1000)
    assert crypto.is_encrypted(locked) and not crypto.is_encrypted(data) and crypto.decrypt_package(locked, "pässword") == data
    with pytest.raises(crypto.WrongPassword):
        crypto.decrypt_package(locked, "wrong")


@pytest.mark.parametrize("method", ["rc4", "aes128", "aes256"])
def test_pdf(method):
    plain = pdf.build(["top secret", "中文"], title="T")
    locked = crypto.encrypt_pdf(plain, "user", "owner", method)
    assert b"top secret".hex().encode() not in locked
    for password in ("user", "owner"):
        d = pdf.Document(locked, password)
        assert d.page_texts() == ["top secret\n中文"] and d.metadata()["title"] == "T"
    with pytest.raises(crypto.WrongPassword):
        pdf.Document(locked, "wrong")


def test_drawing_and_metadata():
    w = pdf.Writer()
    w.info = {"title": "A & B"}
    data = w.rounded(1, 1, 50, 30, 5).arc(50, 50, 20, 10, 0, 200).gradient(0, 0, 10, 10, (1, 0, 0), (0, 0, 1)).qr("hi", 100, 100).rotate(90).line_of("x").save()
    assert b"<rdf:li xml:lang=\"x-default\">A &amp; B" in data and pdf.Document(data).pages()[0]["Rotate"] == 90 and pdf.Document(data).page_texts() == ["x"]


def test_qr():
    rows = qr.matrix("HELLO WORLD")
    assert len(rows) == 21 and [x for x in rows[0][:7]] == [True] * 7 and rows[6][8:13] == [True, False, True, False, True] and rows[13][8]
    assert len(qr.matrix("x" * 200)) == 57 and qr.png("x").startswith(b"\x89PNG")
    # the first block's correction words of the standard's example
    data = [16, 32, 12, 86, 97, 128, 236, 17, 236, 17, 236, 17, 236, 17, 236, 17]
    assert qr._correction(data, 10) == [165, 36, 212, 193, 237, 54, 199, 135, 44, 85]
    with pytest.raises(ValueError):
        qr.matrix("x" * 300)
