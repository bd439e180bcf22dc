from arbor.llm.perspectives import rotate


def brute(rows):
    out, convs = {}, {}
    for c, t, s, x in rows:
        convs.setdefault(c, []).append((t, s, x))
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    for c, turns in convs.items():
        turns.sort(key=key)
        for p in {s for _, s, _ in turns if s not in (None, "system")}:
            text, mask = "", []
            for _, s, x in turns:
                text += "<|system|>\n" if s == "system" else "<|assistant|>\n" if s == p else f"<|user:{s or 'unknown'}|>\n"
                body = (x or "").replace("<|", "<||") + "<|end|>"
                if s == p:
                    mask.append((len(text), len(text) + len(body)))
                text += body + "\n"
            out[c, p] = (text, mask)
    return out


def test_equals_brute_force(spark):
    rows = [(1, 0, "system", "be <|end|> kind"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""), (1, 4, "cid", "x" * 50)]
    rows += [(2, None, "bob", "early"), (2, 5, None, "who"), (None, 1, "ann", "null conversation"), (3, 0, "system", "alone")]
    rows += [(4, t, ["ann", "bob", "cid"][t % 3], f"turn {t}") for t in range(50)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    for size in (1024, 7):
        got = {}
        for r in sorted(rotate(df, segment_turns=size).collect(), key=lambda r: r.segment):
            text, mask = got.get((r.conv_id, r.perspective), ("", []))
            assert r.start == len(text)
            got[r.conv_id, r.perspective] = (text + r.text, mask + [(m.start, m.end) for m in r.mask])
        assert got == brute(rows)
    assert rotate(df.limit(0)).collect() == []


def test_null_turns_and_very_long_texts_equal_sql(spark, tmp_path):
    import os
    import shutil

    from tests.llm.oracle import compare

    rows = [(1, None, "ann", "no turn"), (1, None, "bob", None), (1, 0, "ann", "x" * 2_000_000), (1, 3000, "bob", "<|late|>"), (1, 3000, "bob", "<|late|>"), (2, None, None, "nobody"), (2, 1, "cid", "é" * 70_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in os.listdir("/root/testdata/sf0.001"):
        if name != "conversations.parquet":
            shutil.copy(f"/root/testdata/sf0.001/{name}", tmp_path)
    assert compare(spark, "op1_perspective_rotation", str(tmp_path)) == 8
