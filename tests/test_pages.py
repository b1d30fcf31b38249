from corpusloom.operators import pages as pg


def test_columns(spark):
    page = "\n".join(f"left column of the page, line {i:02d}.".ljust(40) + f"   Right {i:02d}" for i in range(50)) + "\n\n"
    few = "only one line"
    df = spark.createDataFrame([(1, page), (2, few), (3, None), (4, "")], "content_id long, text string")
    got = {r.content_id: r for r in pg.split_columns(df).collect()}
    r = got[1]
    assert (r.lineas_izq, r.lineas_der, r.motivo, r.vacias, r.cortadas) == (50, 50, "OK", 2, 0)
    assert r.izquierda.split("\n")[0] == "left column of the page, line 00." and r.derecha.split("\n")[-1] == "Right 49"
    assert got[2].motivo == "pocas_izquierda" and got[2].width == 48 and 3 not in got and got[4].vacias == 1
