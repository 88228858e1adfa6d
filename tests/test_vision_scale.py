import numpy as np
import pandas as pd

from trialspark.vision import detect, image


def drawn(index, made):
    def draw(batches):
        for pdf in batches:
            made.add(len(pdf))
            px = []
            for i in pdf.frame_index:
                img = np.full((60, 60), 180, np.uint8)
                img[20:28, 5 + 3 * i : 17 + 3 * i] = 30
                px.append(img.tobytes())
            yield pd.DataFrame({"trial_id": pdf.trial_id, "frame_index": pdf.frame_index, "width": 60, "height": 60, "pixels": px})

    return index.mapInPandas(draw, "trial_id long, frame_index long, width int, height int, pixels binary")


def test_each_frame_is_drawn_once_beside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(detect, "BLOCK", 2)
    made = spark.sparkContext.accumulator(0)
    index = spark.range(24).selectExpr("id % 2 AS trial_id", "id div 2 AS frame_index")
    ground = detect.medians(drawn(detect.sampled_frames(index, 5), made))
    out = detect.detect(drawn(index, made), ground, index=index)
    rows = out.collect()
    assert len(rows) == 24 and all(r.found and r.cx == 10.5 + 3 * r.frame_index for r in rows)
    assert made.value == 24 + 2 * 5  # before: 24 for each of numbers, sample, blocks and frames


def test_partitions_grow_with_the_frames(spark, monkeypatch):
    monkeypatch.setattr(detect, "BLOCK", 4)
    made = spark.sparkContext.accumulator(0)
    index = spark.range(80).selectExpr("id % 2 AS trial_id", "id div 2 AS frame_index").where("frame_index < 10 or trial_id = 0")
    frames = drawn(index.selectExpr("trial_id", "frame_index"), made)
    ground = detect.medians(drawn(detect.sampled_frames(index, 3), made))
    assert detect._laid_out(frames, ground, None, index).rdd.getNumPartitions() == 50 // 4 + 1


def test_openings_touch_the_edge():
    mask = np.zeros((9, 30), bool)
    mask[0:5, 24:30] = True
    mask[3, 2] = True
    assert image.open_mask(mask, 2).sum() == 30 and not image.open_mask(mask, 2)[3, 2]
    labels, (first,) = image.components(image.open_mask(mask, 2))
    assert (first.min_x, first.min_y, first.max_x, first.max_y, first.area) == (24, 0, 29, 4, 30) and labels.sum() == 30
