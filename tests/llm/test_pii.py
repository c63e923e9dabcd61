import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from arzyab.llm import pii, pii_train
from arzyab.llm.gate import BUCKET_BITS, Gate
from arzyab.llm.pii_compose import Composer
from arzyab.llm.tagger import Tagger, fit, loss_and_gradients


def test_gradients():
    m = Tagger.fresh(9, 3, 5, seed=2)
    rng = np.random.default_rng(0)
    for p in m.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(p.dtype)
    ids = rng.integers(1, 9, (3, 6))
    ids[1, 4:] = 0
    tags = rng.integers(0, 5, (3, 6)) * (ids > 0)
    _, grads = loss_and_gradients(m, ids, tags)
    for p, g in zip(m.parameters(), grads):
        for at in rng.integers(0, p.size, 4):
            if p is m.table:
                at = at % (p.size - p.shape[1]) + p.shape[1]  # row 0 is padding
            was = p.flat[at]
            p.flat[at] = was + 1e-2
            up = loss_and_gradients(m, ids, tags)[0]
            p.flat[at] = was - 1e-2
            down = loss_and_gradients(m, ids, tags)[0]
            p.flat[at] = was
            assert abs((up - down) / 2e-2 - g.flat[at]) < 2e-2


def test_it_learns():
    rng = np.random.default_rng(1)
    xs = [rng.integers(1, 6, 12) for _ in range(300)]
    ys = [np.where((x == 3) & (np.roll(x, -1) == 4) & (np.arange(12) < 11), 1, 0) for x in xs]  # needs the character to the right
    m = fit(Tagger.fresh(6, 8, 2), xs, ys, epochs=16, batch=32, rate=0.03)
    assert (m.decode(np.stack(xs)) == np.stack(ys)).mean() > 0.99
    again = Tagger.from_arrays(m.arrays())
    assert (again.decode(np.stack(xs)) == m.decode(np.stack(xs))).mean() > 0.999


def held_out(n):
    """Descriptions that training never read: those of sf0.1 beyond the 13,000 with the smallest hash of their id."""
    rows = pq.read_table("/root/testdata/sf0.1/listings.parquet", columns=["source_row_id", "description"]).to_pandas().dropna()
    key = (rows["source_row_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    return list(rows.assign(k=key).sort_values("k")["description"].iloc[13_000 : 13_000 + n])


def test_held_out_accuracy():
    for kind, s in pii_train.score(pii.default_model(), held_out(3000)).items():
        assert s["found"] >= 0.95 and s["right"] >= 0.9 and s["gated"] >= 0.999, (kind, s)


def test_accuracy_on_names_that_training_never_saw():
    for kind, s in pii_train.score(pii.default_model(), held_out(800), Composer(91, held=True, known_carriers=True)).items():
        assert s["found"] >= 0.85 and s["right"] >= 0.95 and s["gated"] >= 0.99, (kind, s)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("آقای محمد کریمی", "person_name", "محمد کریمی"), ("مالک: حسین احمدی", "person_name", "حسین احمدی"), ("با رضا محمدی تماس بگیرید", "person_name", "رضا محمدی"),
        ("هماهنگی با علی محمدی", "person_name", "علی محمدی"), ("John Smith", "person_name", "John Smith"), ("Contact: Sara Ahmadi will show the flat", "person_name", "Sara Ahmadi"),
        ("خیابان ولیعصر شماره ۱۲ واحد ۳", "street_address", "خیابان ولیعصر شماره ۱۲"), ("آدرس: خ پارانزی ک سانوانو پ ۱۲ ط ۳", "street_address", "پ ۱۲"), ("0912 - 345 - 6789", "phone", "0912 - 345 - 6789"),
    ],
)
def test_forms_that_the_patterns_lack(text, kind, part):
    (found,) = pii.find_items([text], pii.default_model())
    assert [k for _, _, k in found] == [kind] and part in text[found[0][0] : found[0][1]]


def test_gate_batches_like_single_texts():
    gate = pii.default_model().gate
    texts = [pii.encode(t)[0] for t in ["", "ab", "تماس 0912", "نور " * 50 + "مالک: حسین احمدی", "x" * 14, "call 09121234567 anytime", *held_out(50)]]
    for many, t in zip(gate.fires_of(texts), texts):
        assert many.tolist() == gate.fires(t).tolist()
    assert gate.fires_of([]) == []


def test_items_and_placeholders(spark):
    text = "سند تک\u200cبرگ - کد ملی ٩٧٢ ٥١٧٨٧٣ ٤ - لطفا با ٠٩٥٦ ٧٢٥ ١٧٩٣ تماس بگیرید - ایمیل darosli_78 @ example.net - سرکار خانم کاوشان سانفامسانزاده پاسخگو هستند - آدرس: بلوار جینسردی نبش کوچه 8 پلاک 172"
    rows = [(1, text), (2, None), (3, ""), (4, "تاریخ تحویل 1403/08/11 توافقی است - کد آگهی 9705351869 را هنگام تماس بفرمایید - هماهنگی با املاک لانکانژاد شعبه مرکزی - پلاک ثبتی 53 فرعی از 143 اصلی دارد"), (5, "نور " * 40_000 + "همراه +98 958 377 2539"), (1, text)]
    df = spark.createDataFrame(rows, "source_row_id long, description string").selectExpr("*", "1 AS pii_type")
    got = sorted(tuple(r) for r in pii.pii_types(df).collect())
    assert got == sorted([(1, k) for k in pii.TYPES] * 2 + [(5, "phone")])
    masked = {r.source_row_id: r for r in pii.mask_descriptions(df).collect()}
    assert masked[1].description.startswith("سند تک\u200cبرگ - کد ملی [ID] - لطفا با [PHONE] تماس بگیرید - ایمیل [EMAIL] - سرکار خانم [NAME] پاسخگو هستند - آدرس: [ADDRESS]")
    assert masked[1]["items"] == 5 and masked[2].description is None and masked[3].description == "" and masked[4]["items"] == 0
    assert pii.pii_types(df.limit(0)).count() == 0


def test_the_network_reads_every_character():
    """The gate has no say in what is found, and no text or stretch is left out."""

    class Recorder:
        def __init__(self):
            self.read = []

        def decode(self, ids):
            self.read += [row[row > 0] for row in ids]
            return np.zeros(ids.shape, dtype=np.int8)

    closed = Gate(np.zeros(1 << BUCKET_BITS, dtype=np.int8), 10**9)  # lets nothing through
    texts = ["", "a", "نور", "نورگیر عالی " * 20, "".join(np.random.default_rng(4).choice(list(pii.ALPHABET), 5000)), None]
    recorder = Recorder()
    pii.find_items(texts, pii.Model(closed, recorder))
    for t in filter(None, texts):
        whole = np.concatenate([pii.LEAD, pii.encode(t)[0]]).tobytes()
        covered = np.zeros(len(whole), dtype=bool)
        for piece in recorder.read:
            at = whole.find(piece.tobytes())
            if at >= 0:
                covered[at : at + len(piece)] = True
        assert covered.all()
    model = pii.default_model()
    text = "سازنده حاج خانم محبی بازسازی کامل - تماس 09121234567"
    assert pii.find_items([text], pii.Model(closed, model.tagger)) == pii.find_items([text], model) != [[]]


def test_decoding_equals_all_paths():
    rng = np.random.default_rng(5)
    for seed in range(20):
        m = Tagger.fresh(9, 3, 3, seed=seed)
        m.trans[:] = rng.normal(0, 2, m.trans.shape)
        m.out *= 5
        ids = rng.integers(1, 9, (4, 6))
        ids[1, 4:] = ids[2, 1:] = ids[3, :] = 0
        e, got = m.numpy_emissions(ids), m.decode(ids)
        for r, n in enumerate((6, 4, 1, 0)):
            score = lambda p: sum(float(e[i, r, k]) for i, k in enumerate(p)) + sum(float(m.trans[a, b]) for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert tuple(got[r, :n]) == max(itertools.product(range(3), repeat=n), key=score) and not got[r, n:].any()


def test_every_region_is_tagged():
    """What the gate lets through is tagged whole, at any length."""
    for start, end in ((0, 5), (3, 900), (10, 10 + pii.WINDOW)):
        covered = np.zeros(1000, dtype=bool)
        for a, b in pii.windows_of(start, end):
            covered[a:b] = True
        assert covered[start:end].all() and covered.sum() == end - start
    assert pii.regions_of(np.array([0, 3, 300]), 310, 40) == [(0, 3 + pii.STRETCH + 40), (260, 310)]
    assert pii.regions_of(np.array([], dtype=int), 310, 40) == []


def test_the_graph_equals_the_states_of_training():
    m = pii.default_model().tagger
    ids = np.random.default_rng(3).integers(1, pii.CHARACTERS, (5, 70))
    ids[1, 30:] = ids[2, 69:] = 0
    assert np.abs(m.emissions(ids) - m.numpy_emissions(ids))[(ids > 0).T].max() < 1e-3


def test_numpy_alone_equals_the_graph():
    m = pii.default_model().tagger
    rng = np.random.default_rng(8)
    ids = rng.integers(1, pii.CHARACTERS, (300, 90), dtype=np.uint8)
    ids[np.arange(90) >= rng.integers(0, 91, 300)[:, None]] = 0  # rows of any length, empty ones too
    real = (ids > 0).T
    for e in (m.emissions(ids), m.wide_emissions(ids)):
        assert e.shape == (90, 300, pii.TAGS) and np.abs(e - m.numpy_emissions(ids))[real].max() < 1e-3


def test_reading_does_without_the_slow_functions_of_numpy(monkeypatch):
    """Without AVX-512 numpy's tanh takes ten times as long as that of the graph, more than all else in a step."""
    pytest.importorskip("onnxruntime")
    text, model = "سازنده حاج خانم محبی بازسازی کامل - تماس 09121234567", pii.default_model()
    want = pii.find_items([text], model)
    monkeypatch.setattr(np, "tanh", None)
    monkeypatch.setattr(np, "exp", None)
    fresh = pii.Model.from_bytes(model.to_bytes())
    assert pii.find_items([text], fresh) == want != [[]]
    monkeypatch.undo()
    fresh.tagger._session = None  # as where onnxruntime is absent
    assert pii.find_items([text], fresh) == want


def test_national_code():
    assert pii.national_code("9725178734") and not pii.national_code("9725178735") and not pii.national_code("1111111111") and not pii.national_code("123")


def test_overlapping_windows_agree_with_the_middle():
    texts = [np.arange(1, 101, dtype=np.uint8) % 90 + 1]

    class Middle:
        def decode(self, ids):
            out = np.zeros(ids.shape, dtype=np.int8)
            out[:, 10:-10] = 1  # only characters far from the edges
            return out

    tags = pii.tag_windows(Middle(), texts, [(0, 0, 60), (0, 30, 100)])[0]
    assert tags[10:90].all() and not tags[:10].any() and not tags[90:].any()
