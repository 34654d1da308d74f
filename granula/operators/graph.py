"""Components of the bond graph, a frame at a time: a frame is one particle, of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least_labels(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least id in each id's component, by halving pointers."""
    number = pd.Series(np.arange(len(ids)), ids)
    a, b = number.loc[i].to_numpy(), number.loc[j].to_numpy()
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return ids[label]
        label = new


def clusters(atoms: DataFrame, half: DataFrame) -> DataFrame:
    """(frame, atom_id, cluster): the smallest atom_id that bonds reach, alone where there is none."""
    key = "frame"

    def label(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(a["atom_id"].to_numpy())
        e = e[e["i"].isin(ids) & e["j"].isin(ids)]
        return pd.DataFrame({"frame": a["frame"].iloc[0] if len(a) else 0, "atom_id": ids, "cluster": _least_labels(ids, e["i"].to_numpy(), e["j"].to_numpy())})

    ends = half.select(F.col(key).alias("of"), "i", "j").groupBy("of")
    return atoms.select(F.col(key).alias(key), "atom_id").groupBy(key).cogroup(ends).applyInPandas(label, "frame long, atom_id long, cluster long")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("frame", "cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy("frame", "size").agg(F.count("*").alias("n"))


def chains(bonds: DataFrame) -> DataFrame:
    """How many chains of each length: components of the atoms with exactly two neighbours."""
    two = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(F.count("*").alias("cn")).where("cn = 2").select("frame", "atom_id")
    inner = bonds.where("i < j").join(two.withColumnRenamed("atom_id", "i"), ["frame", "i"]).join(two.withColumnRenamed("atom_id", "j"), ["frame", "j"])
    return cluster_sizes(clusters(two, inner)).withColumnRenamed("size", "length")
