"""Small grids and levels that the tests share."""

from datetime import datetime, timedelta

from haloflux.schema import COLUMNS_SCHEMA, SLevels


def uniform_levels(n=3, hc=10.0, vtransform=2):
    s_w = tuple(k / n - 1.0 for k in range(n + 1))
    s_rho = tuple((k + 0.5) / n - 1.0 for k in range(n))
    return SLevels(s_rho, s_rho, s_w, s_w, hc, vtransform)


T0 = datetime(2010, 6, 1)


def step(n, hours=1):
    return T0 + timedelta(hours=hours * n)


def make_columns(
    spark, nt=1, nk=3, nj=4, ni=4, salt=lambda t, k, j, i: 32.0, temp=lambda t, k, j, i: 10.0,
    u=lambda t, k, j, i: 0.5, v=lambda t, k, j, i: 0.0, aks=lambda t, k, j, i: 1e-3,
    zeta=lambda t, j, i: 0.0, h=lambda j, i: 30.0, pm=lambda j, i: 1e-3, pn=lambda j, i: 1e-3, skip=(),
):
    """A small packed grid from functions of the indices."""
    rows = []
    for t in range(nt):
        for j in range(nj):
            for i in range(ni):
                if (j, i) in skip:
                    continue
                pack = lambda f, m=nk: [f(t, k, j, i) for k in range(m)]
                rows.append(
                    (step(t), j, i, h(j, i), pm(j, i), pn(j, i), 7e-5, -94.0 + i, 28.0 + j, zeta(t, j, i), 0.0,
                     pack(salt), pack(temp), pack(aks, nk + 1), pack(u), pack(v))
                )
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)
