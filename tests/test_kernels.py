"""Pixel kernels: invariants, and the whole image pass."""

import numpy as np
import pytest

from gradus.functions import kernels as K
from gradus.operators import imaging
from gradus.plans import degradation


@pytest.fixture(scope="module")
def img():
    return np.random.default_rng(1).random((64, 64)).astype(np.float32)


MASK = np.ones((64, 64), bool)


def test_unit_range():
    assert K.unit_range(np.array([[0, 2], [4, np.nan]])).tolist() == [[0, 0.5], [1, 0]]
    assert not K.unit_range(np.full((3, 3), 7.0)).any()


def test_window_of_flat_images():
    assert K.fixed_window(np.full((4, 4), 3.0)) == (3.0, 4.0)


def test_otsu_takes_the_lowest_of_equal_partings():
    v = np.array([1, 85, 116, 200]) / 201  # either end alone parts them equally well; sums differ in their last bits
    assert K.otsu(v) < v[1]


def test_breast_mask_finds_the_rectangle():
    x = np.zeros((256, 256), np.float32)
    x[50:200, 30:180] = 1000
    m = K.breast_mask(x)
    assert m[60:190, 40:170].all() and not m[:30].any()
    assert not K.breast_mask(np.zeros((64, 64))).any()


def test_distance_and_morphology():
    m = np.zeros((20, 20), bool)
    m[5:15, 5:15] = True
    y, x = np.nonzero(~m)
    want = np.array([[((y - i) ** 2 + (x - j) ** 2).min() if m[i, j] else 0 for j in range(20)] for i in range(20)])
    assert np.allclose(K.squared_distance(m), want)
    assert K.erode(K.dilate(m, 3), 3)[6:14, 6:14].all()
    assert (K.close_(m, 2) >= m).all()


def test_components():
    m = np.array([[1, 0, 1], [0, 1, 0], [1, 1, 0]], bool)
    assert len(np.unique(K.components(m))) == 4
    assert len(np.unique(K.components(m, diagonal=True))) == 2
    ring = np.ones((7, 7), bool)
    ring[3, 3] = False
    assert K.fill_holes(ring, 1).all() and not K.drop_small(m, 9).any()
    assert K.convex_hull(ring).all()


def test_blur(img):
    assert K.tenengrad(K.motion_blur(img, 11)) < K.tenengrad(img)
    assert K.blur_kernel(9, 30).sum() == pytest.approx(1)
    assert np.allclose(K.motion_blur(np.full((8, 32), 0.5, np.float32), 7), 0.5)
    assert K.odd_length(1.0, 0.3) % 2 == 1


def test_contrast(img):
    assert np.allclose(K.reduce_contrast(img, 1.0, MASK), img, atol=1e-6)
    assert K.reduce_contrast(img, 0.5, MASK).std() < img.std()
    half = MASK.copy()
    half[:, 32:] = False
    assert (K.reduce_contrast(img, 0.5, half)[:, 32:] == img[:, 32:]).all()
    assert (K.reduce_contrast(img, 0.5, half, variant="toolkit")[:, 32:] != img[:, 32:]).any()
    with pytest.raises(ValueError):
        K.reduce_contrast(img, 0.0)


def test_noise(img):
    assert (K.dose_noise(img, 1.0, 0.1, 3) == img).all()
    a, b = K.dose_noise(img, 0.5, 0.05, 3), K.dose_noise(img, 0.5, 0.05, 3)
    assert (a == b).all() and (a != K.dose_noise(img, 0.5, 0.05, 4)).any()
    flat = np.full((128, 128), 0.5, np.float32)
    assert K.dose_noise(flat, 0.35, 0.05, 1).std() == pytest.approx(0.05 * (1 / 0.35 - 1) ** 0.5, rel=0.05)


def test_resolution(img):
    out = K.reduce_resolution(img, 0.4)
    assert out.shape == img.shape and out.std() < img.std()
    assert np.allclose(K.area_weights(10, 4).sum(axis=1), 1) and np.allclose(K.cubic_weights(4, 10).sum(axis=1), 1)
    assert np.allclose(K.reduce_resolution(np.full((16, 16), 0.3, np.float32), 0.5), 0.3)


def test_no_codec_says_so(img):
    with pytest.raises(NotImplementedError):
        K.jpeg2000(img, 10)
    assert K.wavelet_quant(img, 4).shape == img.shape
    assert K.psnr(img, K.wavelet_quant(img, 1)) > 60 or np.allclose(img, K.wavelet_quant(img, 1), atol=1e-3)


def test_quality(img):
    assert K.ssim_full(img, img) == pytest.approx(1) and K.ssim_masked(img, img, MASK) == pytest.approx(1)
    worse = [K.ssim_full(img, K.motion_blur(img, n)) for n in (3, 7, 15)]
    assert worse == sorted(worse, reverse=True)
    assert K.psnr(img, img) == float("inf")
    noisy = [K.tau_nms(0.5 + s * np.random.default_rng(2).normal(size=(64, 64))) for s in (0.01, 0.02, 0.04)]
    assert noisy == sorted(noisy)
    assert K.tau_nms(np.full((8, 8), 0.5)) == 0 and K.tau_extrema(np.full((8, 8), 0.5)) == 0
    assert np.isnan(K.contrast_iqr(img, np.zeros((64, 64), bool)))
    assert K.noise_variance(np.full((4, 4), 2.0), (0, 0, 4, 4)) == 0


def test_cnr_is_invariant_to_contrast():
    rng = np.random.default_rng(4)
    x = (0.4 + 0.02 * rng.normal(size=(64, 64))).astype(np.float32)
    lesion = K.box_mask(x.shape, (28, 28, 36, 36))
    x[lesion] += 0.2
    around = K.ring((28, 28, 36, 36), MASK)
    a, b = K.cnr(x, lesion, around), K.cnr(K.reduce_contrast(x, 0.7, MASK), lesion, around)
    assert b[0] == pytest.approx(a[0], rel=1e-3) and b[1] == pytest.approx(0.7 * a[1], rel=1e-3)
    assert K.cnr(np.where(lesion, 1.0, 0.0), lesion, around, "toolkit")[0] == float("inf")
    assert not (around & lesion).any()


def test_boxes():
    assert not K.box_mask((4, 4), (9, 9, 12, 12)).any()
    with pytest.raises(ValueError):
        K.box_mask((4, 4), (9, 9, 12, 12), strict=True)


def test_patch_is_the_calmest():
    rng = np.random.default_rng(0)
    x = rng.random((96, 96)).astype(np.float32)
    x[48:80, 48:80] = 0.5
    b = K.tissue_patch(x, np.ones((96, 96), bool), size=16, margin=8)
    assert 40 <= b[0] <= 72 and 40 <= b[1] <= 72
    assert K.tissue_patch(x, np.zeros((96, 96), bool), size=16) is None
    assert K.tissue_patch(x[:8, :8], np.ones((8, 8), bool), size=16) is None


def test_plan():
    s = degradation.specs()
    assert len(s) == 31 and s[0][1] == "clean" and len({r[1:3] for r in s}) == 31
    assert degradation.single("clean", 4)[1] == 0
    for bad in (("nope", 1), ("blur", 7)):
        with pytest.raises(ValueError):
            degradation.single(*bad)


def test_image_pass(spark):
    good, box = imaging.phantom(3)
    rows = [(1, 64, 48, good, box, []), (2, 64, 48, b"short", None, None), (3, 64, 48, good, None, None)]
    out = imaging.evaluate(spark.createDataFrame(rows, imaging.IMAGE), patch_size=16, margin=8).toPandas()
    bad = out[out.image_id == 2]
    assert len(bad) == 1 and bad.processing_status.iloc[0] == "ERROR"
    one = out[out.image_id == 1].set_index(["degradation_type", "severity"])
    assert len(one) == 31 and (one.loc["jpeg2000"].processing_status == "variant_failed").all()
    assert one.loc[("clean", 0)].ssim_masked == 1
    assert one.loc[("contrast", 6)].cnr == pytest.approx(one.loc[("clean", 0)].cnr, rel=1e-2)
    assert one.loc[("noise", 6)].tau_extrema > one.loc[("clean", 0)].tau_extrema
    assert out[out.image_id == 3].cnr.isna().all()
    s = imaging.run_summary(spark.createDataFrame(out[["image_id", "processing_status"]])).first()
    assert (s.n_images, s.n_errors, s.n_variants_failed) == (3, 1, 12)


def test_ladder_dilation_and_flips(img):
    assert list(K.resolution_ladder(img, [2, 5])) == [2, 5]
    with pytest.raises(ValueError):
        K.resolution_ladder(img, [7])
    d = K.lesions_dilated((20, 20), [(8, 8, 10, 10)], 2)
    assert d[8, 6] and not d[8, 5] and d.sum() < 64
    assert [n for _, n, _ in K.blur_schedule()] == sorted({n for _, n, _ in K.blur_schedule()})
    assert imaging.flip_averaged(lambda x: float(x[0, 0]))(np.array([[1.0, 3.0]])) == 2
