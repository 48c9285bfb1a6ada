"""Standard normal CDF and quantile as native column expressions.

CDF: Hart's rational approximation in the form published by West (2005),
"Better approximations to cumulative normal functions".
Quantile: Wichura (1988), algorithm AS 241 (PPND16).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients.
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
AS241_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
AS241_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
AS241_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
           1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
AS241_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
AS241_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
           2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
AS241_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _horner(coef, x: Column) -> Column:
    """Highest power first."""
    acc = F.lit(float(coef[0]))
    for c in coef[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def norm_cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    body = e * _horner(HART_NUM, a) / _horner(HART_DEN, a)
    frac = a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + F.lit(0.65)))))
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, body).otherwise(e / frac / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Quantile for 0 < p < 1, null elsewhere."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _horner(AS241_A[::-1], r) / _horner(AS241_B[::-1], r)
    t = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    near = _horner(AS241_C[::-1], t - 1.6) / _horner(AS241_D[::-1], t - 1.6)
    far = _horner(AS241_E[::-1], t - 5.0) / _horner(AS241_F[::-1], t - 5.0)
    tail = F.when(t <= 5, near).otherwise(far) * F.signum(q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(tail))
